"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Text is folded first: case, homoglyphs (letters of other scripts and accents that look like Latin ones stay apart unless listed),
digits and signs that stand for letters; what is no letter becomes one space. An entry matches a whole word, or (with a star)
the start of one. Entries are learned from at most `sample` labelled rows: every word of at least 4 letters, whole, and besides its
beginnings of STEMS letters, that toxic documents have more often than others. The evidence is relative: the chance of counts as far
from the labels' shares (Chernoff's bound) must be under one in all the words and beginnings tried (Tarone's rule: those too rare to
pass at all don't count), so less than one entry is expected to be there by chance; no count of documents or entries is fixed.
Copies of a text count once. The smoothed log odds are the weight; of words and beginnings that say the same, the
longest that keeps nearly all documents of a beginning stands for the rest. SEED adds general insults that need no
training. A match inside an exception phrase doesn't count. The score is a logistic function of the summed weight and of that weight per word (length normalised), fitted on the same rows.

Null and empty texts score like a text without a match. Without labelled rows of both kinds the seed list scores
alone. Repeated rows score alike. A score reads the text alone, the whole of it, in time proportional to its length. The lexicon's size is
bounded by the words of the toxic documents in the sample.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adam, bounded_sample, column, materialize, pick, sigmoid

SAMPLE, LEAST_ODDS = 20_000, 2.0
#: Lengths of the beginnings that are tried besides whole words.
STEMS = range(4, 13)
#: General insults, phrases in which such a word is harmless, and characters that stand for letters.
SEED = "idiot moron stupid imbecile scum loser worthless pathetic disgusting trash clown retard bastard bitch asshole".split()
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "trash collection", "clown car", "idiot proof"]
LOOKALIKES = "аaеeоoрpсcхxуyіiјjѕsԁdɡgһhκkνvοoαaρpτtιi"
SIGNS = "0o1i3e4a5s7t@a$s"
FOLD = {ord(LOOKALIKES[i]): LOOKALIKES[i + 1] for i in range(0, len(LOOKALIKES), 2)} | {ord(SIGNS[i]): SIGNS[i + 1] for i in range(0, len(SIGNS), 2)}
OTHER = re.compile(r"[\W\d_]+")
SEED_WEIGHT = 4.0


def fold(text: str) -> str:
    return " " + OTHER.sub(" ", text.lower().translate(FOLD)) + " "


def _evidence(batches):
    """Words (whole) and their beginnings (with a star) of each labelled document, each once."""
    for batch in batches:
        label, entry = [], []
        for y, text in zip(column(batch, "label").to_pylist(), column(batch, "text").to_pylist()):
            words = {w for w in fold(text or "").split() if len(w) >= STEMS[0]}
            found = words | {w[:n] + "*" for w in words for n in STEMS if n <= len(w)}
            entry += found
            label += [y] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(entry, pa.string())], names=["label", "entry"])


def evidence(p, n, toxic: int, clean: int):
    """Columns: smoothed log odds of an entry in toxic against other documents, and minus the log of the chance of its counts."""
    odds = F.log((p + F.lit(0.5)) / (toxic + 1)) - F.log((n + F.lit(0.5)) / (clean + 1))
    far = lambda x, share: F.when(x > 0, x * F.log(x / ((p + n) * F.lit(share)))).otherwise(0.0)
    return odds, far(p, toxic / (toxic + clean)) + far(n, clean / (toxic + clean))


def tried(by_docs: dict[int, int], toxic: int, clean: int) -> float:
    """The entries that could pass, were all their documents toxic; by_docs: entries by their number of documents."""
    best = float(np.log((toxic + clean) / toxic))
    for docs in sorted(by_docs):
        many = sum(c for k, c in by_docs.items() if k >= docs)
        if docs * best >= np.log(many):
            return float(many)
    return float(max(1, sum(by_docs.values())))


def choose(rows: list[tuple[str, int, float]]) -> dict[str, float]:
    """Entries and weights from (word or beginning with a star, toxic documents, log odds). A beginning goes where a longer one keeps
    nearly all its documents; what a kept beginning covers goes."""
    docs, odds = {e: p for e, p, _ in rows}, {e: o for e, _, o in rows}
    longer: dict[str, int] = {}
    for e, p in docs.items():
        if e.endswith("*"):
            longer[e[:-2]] = max(p, longer.get(e[:-2], 0))
    out: dict[str, float] = {}
    for e in sorted(docs, key=lambda e: (e.rstrip("*"), not e.endswith("*"))):
        word = e.rstrip("*")
        if e.endswith("*") and (longer.get(word, 0) >= 0.95 * docs[e] or docs.get(word, 0) >= 0.95 * docs[e]):
            continue
        if any(word[:n] + "*" in out for n in range(STEMS[0], len(word))) or (not e.endswith("*") and e + "*" in out):
            continue
        out[e] = odds[e]
    return out


class Lexicon:
    def __init__(self, entries: dict[str, float]):
        self.entries = {e + "*": SEED_WEIGHT for e in SEED} | entries
        self.automaton = None

    def __getstate__(self):
        return {"entries": self.entries, "automaton": None}

    def build(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for e, w in self.entries.items():
                if e.endswith("*"):
                    self.automaton.add_word(" " + e[:-1], (len(e), w, e))
                else:
                    self.automaton.add_word(f" {e} ", (len(e) + 2, w, e))
            for e in EXCEPTIONS:
                self.automaton.add_word(" " + e + " ", (len(e) + 2, None, e))
            self.automaton.make_automaton()
        return self.automaton

    def hits(self, text: str | None) -> tuple[list[str], float, int]:
        """(entries found, their weight, words)."""
        folded = fold(text or "")
        found: dict[int, tuple[str, float]] = {}
        harmless = []
        for end, (n, w, e) in self.build().iter(folded):
            at = end - n + 1
            if w is None:
                harmless.append((at, end))
            elif at not in found or found[at][1] < w:
                found[at] = (e, w)
        good, reach, phrases = [], -1, iter(sorted(harmless))
        phrase = next(phrases, None)
        for at in sorted(found):  # both in order of place
            while phrase and phrase[0] <= at:
                reach, phrase = max(reach, phrase[1]), next(phrases, None)
            if at >= reach:
                good.append(found[at])
        return [e for e, _ in good], sum(w for _, w in good), folded.count(" ") - 1


def features(weight, words):
    return np.stack([np.log1p(weight), np.log1p(100 * weight / np.maximum(1, words))], -1)


def _measured(lexicon):
    def run(batches):
        for batch in batches:
            found = [lexicon.hits(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "label"), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64())], names=["label", "weight", "words"])

    return run


class Model:
    def __init__(self, lexicon, a, b):
        self.lexicon, self.a, self.b = lexicon, a, b

    def score(self, weight, words):
        return sigmoid(features(np.asarray(weight, float), np.asarray(words, float)) @ self.a + self.b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: (doc_id, label 0 or 1)."""
    known = F.broadcast(bounded_sample(labels, sample))
    rows = pick(docs, "doc_id", "text").join(known, "doc_id").select(F.col("label").cast("int").alias("label"), "text")
    texts = materialize(rows.filter("text is not null").distinct())
    kinds = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    toxic, clean = kinds.get(1, 0), kinds.get(0, 0)
    counts = texts.mapInArrow(_evidence, "label int, entry string").groupBy("entry").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    strong: list = []
    if toxic and clean:
        counts = materialize(counts)
        many = tried({r["k"]: r["count"] for r in counts.groupBy((F.col("p") + F.col("n")).alias("k")).count().collect()}, toxic, clean)
        odds, sure = evidence(F.col("p"), F.col("n"), toxic, clean)
        strong = counts.withColumn("odds", odds).filter((F.col("odds") >= LEAST_ODDS) & (sure >= float(np.log(many)))).collect()
    lexicon = Lexicon(choose([(r["entry"], r["p"], r["odds"]) for r in strong]))
    got = rows.mapInArrow(_measured(lexicon), "label int, weight double, words long").collect()
    if not (toxic and clean):
        return Model(lexicon, np.array([2.0, 1.0]), -3.0)
    y = np.array([r["label"] for r in got], float)
    x = features(np.array([r["weight"] for r in got]), np.array([r["words"] for r in got], float))

    def gradient(p):
        g = (sigmoid(x @ p[0] + p[1]) - y) / len(y)
        return [x.T @ g + 1e-4 * p[0], np.array(g.sum())]

    a, b = adam(gradient, [np.zeros(2), np.array(0.0)], 400, 0.1)
    return Model(lexicon, a, float(b))


def _scores(model):
    def run(batches):
        for batch in batches:
            found = [model.lexicon.hits(t) for t in column(batch, "text").to_pylist()]
            score = model.score([f[1] for f in found], [f[2] for f in found])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array([sorted(set(f[0])) for f in found], pa.list_(pa.string()))], names=["doc_id", "score", "terms"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, score, terms (the entries found)."""
    return pick(docs, "doc_id", "text").mapInArrow(_scores(model), "doc_id long, score double, terms array<string>")
