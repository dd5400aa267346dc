"""Quality by a linear-chain conditional random field over the lines of a document.

Each line (between newlines; blank ones are left out) is good or bad. Its potential is linear in features of the line and of the lines before
and after it (letter case, signs, digits, separators, word lengths, repeated words, length), and neighbouring labels share a
2 x 2 table. Forward and backward passes give each line's marginal; their mean, weighted by line length, is the document's share
of good text, and a logistic function fitted on the labelled sample turns it into the score.

Training takes at most `sample` labelled documents, the first by a hash of doc_id; a document's label stands for its lines, and the
likelihood of these sequences is maximised by its exact gradient. Scoring covers every line of every whole text.

Null, empty and blank texts have no line: their share of good text is 0. Without labels of both kinds the weights are 0 and scores are alike. Repeated rows
score alike. A score reads the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, adam, bounded_sample, column, pick, sigmoid, slices

SAMPLE = 4000


def _class(test) -> np.ndarray:
    return np.array([bool(test(c)) for c in range(256)])


KINDS = [
    _class(lambda c: chr(c).isupper() and c < 128),
    _class(lambda c: chr(c).islower() and c < 128),
    _class(lambda c: 48 <= c < 58),
    _class(lambda c: c >= 128),
    _class(lambda c: chr(c) in ".,;:'\"?()-"),
    _class(lambda c: chr(c) in "|>/\\=_~^"),
    _class(lambda c: chr(c) in "!#$%&*+@<{}[]`"),
    _class(lambda c: chr(c) == " "),
]
OWN = len(KINDS) + 8


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, text number, length) of each line with a word in it."""
    newline = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate((off[:-1], newline + 1)))
    begin = begin[begin < len(buf)]
    end = np.append(begin[1:], len(buf))
    w = Words(buf, off, False)
    line = np.searchsorted(begin, w.start, side="right") - 1
    n = np.bincount(line, minlength=len(begin))
    keep = n > 0
    size = (end - begin).astype(float)
    total = [np.concatenate(([0], np.cumsum(k[buf]))) for k in KINDS]
    share = [(t[end] - t[begin]) / np.maximum(1, size) for t in total]
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((w.hash, line))
    again = np.zeros(len(w.hash), bool)
    again[order[1:]] = (w.hash[order][1:] == w.hash[order][:-1]) & (line[order][1:] == line[order][:-1])
    by = lambda x: np.bincount(line, weights=x, minlength=len(begin)) / np.maximum(1, n)
    length = (w.end - w.start).astype(float)
    last = KINDS[4][buf[np.maximum(w.end - 1, 0)]] if len(buf) else np.zeros(0)
    odd = KINDS[6][buf[np.maximum(w.end - 1, 0)]] if len(buf) else np.zeros(0)
    upper = np.minimum(1, 4 * share[0]) * (share[1] < 0.05)
    own = np.stack([*share, upper, by(same), by(again), np.minimum(by(length), 30) / 10, by(length * length) / 200, by(last), by(odd), np.log1p(n) / 5], 1)[keep]
    text = np.searchsorted(off, begin[keep], side="right") - 1
    return own, text, size[keep]


def with_neighbours(own: np.ndarray, text: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = (text[1:] == text[:-1])[:, None]
    before[1:] = own[:-1] * joined
    after[:-1] = own[1:] * joined
    return np.concatenate((own, before, after, np.ones((len(own), 1))), 1)


def step(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of the next label, before its own potential, from the log odds of this one."""
    return np.logaddexp(a + t[1, 1], t[0, 1]) - np.logaddexp(a + t[1, 0], t[0, 0])


def chain(u: np.ndarray, text: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds (own potential included) and backward log odds of every line; all documents go abreast."""
    fwd, bwd = u.copy(), np.zeros_like(u)
    if not len(u):
        return fwd, bwd
    begin = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    size = np.diff(np.append(begin, len(u)))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    reach = np.searchsorted(-size, -np.arange(1, size[0]), side="left")  # documents with more than k lines
    for k in range(1, size[0]):
        at = begin[: reach[k - 1]] + k
        fwd[at] += step(fwd[at - 1], t)
    for k in range(size[0] - 1, 0, -1):
        at = begin[: reach[k - 1]] + k
        bwd[at - 1] = step(bwd[at] + u[at], t.T)
    return fwd, bwd


class Model:
    def __init__(self, w=None, t=None, a=1.0, b=0.0):
        self.w = np.zeros(3 * OWN + 1) if w is None else w
        self.t = np.zeros((2, 2)) if t is None else t
        self.a, self.b = a, b

    def good(self, own, text, size, rows):
        """The length-weighted mean marginal of each of `rows` texts."""
        u = with_neighbours(own, text) @ self.w
        fwd, bwd = chain(u, text, self.t)
        p = sigmoid(fwd + bwd)
        return np.bincount(text, weights=p * size, minlength=rows) / np.maximum(1, np.bincount(text, weights=size, minlength=rows))

    def score(self, good):
        return sigmoid(self.a * (good - 0.5) + self.b)


def fit(own, text, size, label, rows, turns: int = 150) -> Model:
    """label: of each text, 0 or 1."""
    if len(set(label)) < 2 or not len(own):
        return Model()
    label = np.asarray(label)
    x, y = with_neighbours(own, text), label[text].astype(float)
    share = label.mean()
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))[text]  # both kinds count alike
    joined = text[1:] == text[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][joined].astype(int), y[1:][joined].astype(int)), weight[1:][joined])

    def gradient(p):
        w, t = p
        u = x @ w
        fwd, bwd = chain(u, text, t)
        g = x.T @ ((sigmoid(fwd + bwd) - y) * weight) / len(y) + 1e-4 * w
        a, b = fwd[:-1][joined], (bwd + u)[1:][joined]
        pair = np.stack([np.zeros_like(a) + t[0, 0], b + t[0, 1], a + t[1, 0], a + b + t[1, 1]])
        pair = np.exp(pair - np.logaddexp.reduce(pair, 0)) * weight[1:][joined]
        return [g, (pair.sum(1).reshape(2, 2) - seen) / len(y) + 1e-2 * t]

    w, t = adam(gradient, [np.zeros(x.shape[1]), np.zeros((2, 2))], turns, 0.1)
    model = Model(w, t)
    z = model.good(own, text, size, rows) - 0.5

    def calibrate(p):
        g = (sigmoid(p[0] * z + p[1]) - label) / len(z)
        return [np.array((g * z).sum() + 1e-4 * p[0]), np.array(g.sum())]

    a, b = adam(calibrate, [np.array(1.0), np.array(0.0)], 500, 0.2)
    return Model(w, t, float(a), float(b))


def _lines(batches):
    for batch in batches:
        labels = column(batch, "label")
        for row, buf, off in slices(column(batch, "text")):
            own, text, size = lines(buf, off)
            at = np.searchsorted(text, np.arange(len(off)))
            out = [np.column_stack((own[lo:hi], size[lo:hi])).astype(np.float32).tobytes() for lo, hi in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([labels.slice(row, len(out)), pa.array(out, pa.binary())], names=["label", "lines"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: (doc_id, label 0 or 1)."""
    known = F.broadcast(bounded_sample(labels, sample))
    rows = pick(docs, "doc_id", "text").join(known, "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    got = [(r["label"], bytes(r["lines"])) for r in rows.select("label", "text").mapInArrow(_lines, "label int, lines binary").collect()]
    got.sort()
    data = [np.frombuffer(b, np.float32).reshape(-1, OWN + 1) for _, b in got]
    text = np.repeat(np.arange(len(data)), [len(d) for d in data])
    flat = np.concatenate(data).astype(float) if data else np.zeros((0, OWN + 1))
    return fit(flat[:, :-1], text, flat[:, -1], [y for y, _ in got], len(data))


def _scores(model):
    def run(batches):
        for batch in batches:
            ids = column(batch, "doc_id")
            for row, buf, off in slices(column(batch, "text")):
                good = model.good(*lines(buf, off), len(off) - 1)
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(good)), pa.array(model.score(good)), pa.array(good)], names=["doc_id", "score", "good_share"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, score, good_share (length-weighted mean marginal of its lines)."""
    return pick(docs, "doc_id", "text").mapInArrow(_scores(model), "doc_id long, score double, good_share double")
