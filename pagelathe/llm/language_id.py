"""Language identification by error-correcting output codes.

Every learned language has a codeword. For each bit a linear classifier over hashed byte n-grams (2 and 3 bytes of lower-cased
letters, other characters as one space) predicts that bit. Decoding takes the language whose codeword loses least: the sum over bits of
the bit's weight (its accuracy in training above chance) times the logistic loss of the classifier's margin. A document is
flagged as ambiguous when its score, the normalised likelihood of the nearest codeword, is under `sure`. Up to seven languages get the exhaustive code (2**(L-1) - 1 bits),
more get random bits drawn with a fixed seed.

Bits are fitted on at most `sample` labelled documents, the first by a hash of doc_id; whole texts, of the sample as of the rest.
Null text, and text without a letter, is `und` with score 0. Without labelled documents all are `und`. Repeated rows are
each predicted. A prediction reads the text alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adam, bounded_sample, column, pick, sigmoid

BINS, SAMPLE, SURE, RANDOM_BITS = 1 << 13, 3000, 0.5, 12
LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def profile(text: str) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams, without those that hold two spaces."""
    b = np.frombuffer((" " + text.lower() + " ").encode().translate(ASCII_LETTERS), np.uint8)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = b[keep].astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    codes = np.concatenate((two | np.uint32(1 << 24), three)) * np.uint32(2654435761) >> np.uint32(19)
    return np.bincount(codes, minlength=BINS)


def _profiles(batches):
    for batch in batches:
        out = []
        for text in column(batch, "text").to_pylist():
            n = profile(text or "")
            at = np.flatnonzero(n)
            out.append(at.astype(np.uint16).tobytes() + (n[at] / max(1, n.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([column(batch, "label"), pa.array(out, pa.binary())], names=["label", "profile"])


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """(languages, bits) of -1 and 1; no bit is constant."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= 7:
        bits = np.arange(1, 1 << (languages - 1))
        rows = [np.zeros(len(bits), int)] + [bits >> i & 1 for i in range(languages - 1)]
        return np.where(np.array(rows) > 0, 1, -1).astype(np.int8)
    rng = np.random.default_rng(seed)
    code = rng.choice(np.array([-1, 1], np.int8), (languages, RANDOM_BITS * int(np.ceil(np.log2(languages)))))
    return code[:, np.abs(code.sum(0)) < languages]


class Model:
    def __init__(self, languages, code, weight, bias, trust):
        self.languages, self.code, self.weight, self.bias, self.trust = languages, code, weight, bias, trust

    def margins(self, x):
        return x @ self.weight + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest codeword, its normalised likelihood); ties go to the smaller language."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)
        like = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), 1 / like.sum(1)


def fit(rows: list[tuple[str, bytes]], turns: int = 120) -> Model:
    languages = sorted({lang for lang, _ in rows}, key=lambda s: s.encode("utf-32-be"))
    code = codewords(len(languages))
    x = np.zeros((len(rows), BINS), np.float32)
    for i, (_, p) in enumerate(rows):
        n = len(p) // 6
        x[i, np.frombuffer(p, np.uint16, n)] = np.sqrt(np.frombuffer(p[2 * n :], np.float32, n))
    y = code[[languages.index(lang) for lang, _ in rows]].astype(np.float32) if rows else np.zeros((0, 0), np.float32)

    def gradient(p):
        w, b = p[0].astype(np.float32), p[1].astype(np.float32)
        g = -y * sigmoid(-y * (x @ w + b)) / max(1, len(x))
        return [x.T @ g + 1e-5 * w, g.sum(0)]

    w, b = adam(gradient, [np.zeros((BINS, code.shape[1])), np.zeros(code.shape[1])], turns if code.shape[1] else 0, 0.2)
    right = ((x @ w.astype(np.float32) + b) * y > 0).mean(0) if len(x) else np.zeros(0)
    return Model(languages, code, w, b, np.maximum(0.05, 2 * right - 1))


def predicted(model: Model, texts: list, sure: float) -> tuple[list, list, list]:
    """(language, score, ambiguous) of each text."""
    lang, score = [], []
    for lo in range(0, len(texts), 256):
        some = texts[lo : lo + 256]
        known = [bool(t and model.languages and LETTER.search(t)) for t in some]
        x = np.array([np.sqrt(n / max(1, n.sum())) for n in (profile(t) for t, k in zip(some, known) if k)]).reshape(-1, BINS)
        best, p = model.decode(model.margins(x)) if len(model.languages) > 1 else (np.zeros(len(x), int), np.ones(len(x)))
        it = iter(zip(best, p))
        for k in known:
            n, s = next(it) if k else (None, 0.0)
            lang.append(model.languages[n] if k else "und")
            score.append(float(s))
    return lang, score, [x == "und" or s < sure for x, s in zip(lang, score)]


def _predict(model: Model, sure: float):
    def run(batches):
        for batch in batches:
            lang, score, ambiguous = predicted(model, column(batch, "text").to_pylist(), sure)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def _recognised(model: Model, sure: float):
    def run(batches):
        for batch in batches:
            _, _, ambiguous = predicted(model, column(batch, "text").to_pylist(), sure)
            yield batch.filter(pa.array([not a for a in ambiguous], pa.bool_()))

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: (doc_id, label)."""
    known = F.broadcast(bounded_sample(labels, sample))
    rows = pick(docs, "doc_id", "text").filter("text is not null").join(known, "doc_id").select("label", "text").mapInArrow(_profiles, "label string, profile binary").collect()
    return fit(sorted((r["label"], bytes(r["profile"])) for r in rows))


def identify(docs: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """One row for each document: doc_id, lang_pred, score, ambiguous."""
    return pick(docs, "doc_id", "text").mapInArrow(_predict(model, sure), "doc_id long, lang_pred string, score double, ambiguous boolean")


def recognised(docs: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """docs without those of no language: no letters, or a codeword that is hardly nearer than the next. Rows pass whole, with all
    columns, in one pass."""
    return docs.mapInArrow(_recognised(model, sure), docs.schema)
