"""Substring dedup by relative Lempel-Ziv parsing at the level of words.

The reference is the corpus itself, cut into blocks. In a window of `width` words the least of its seeds (runs of `k` words, in the
order of a hash) is chosen; successive windows with one seed make a segment, and a segment goes, as text, to the block of its seed.
Equal windows choose equal seeds, so all places of a window lie in one block, and only that block need be asked.

A block is indexed by prefix doubling: ranks of 1, 2, 4, ... words give the order of all its suffixes, by the words themselves.
Each of its segments is then factored greedily: at the first window that occurs at another place, the longest match is found by
extending word by word along the neighbours in that order; where the factor ends, the windows that straddle its end are
looked up on their own before the next begins. So the union of the factors is exactly the words covered by a window that
also starts anywhere else. Of equal segments the first by (doc_id, hash of the text, place) is the place to follow, so that
neighbouring segments follow one; their factors are glued. A factor is thus the longest in each block that it crosses. Hashes only deal; words decide.

Equal segments of a task are settled there, and one goes on: a passage found in a third of all documents costs a row a task.
Blocks are taken one after another, in sorted order, and a task holds one. A block that outgrows `limit` words is dealt again by
longer seeds, at last by whole windows, of which only different ones are held. Factors travel by (doc_id, hash of the text), so
copies of one text under several ids are spread.

Null text has no words. Documents shorter than the window keep all. Repeated rows are each other's copies. A null doc_id
is kept as it is; rows equal in both doc_id and text share their factors. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_BASE, Words, binary, by_bucket, column, ids_of, materialize, mix, pick, reducers, slices, spans

#: Words that a block should hold; words of a seed in each round of dealing (then whole windows); windows a task settles at once.
BLOCK_WORDS, SEEDS, CHUNK = 1_000_000, (5, 11, 23), 1 << 20
ROW = "kind int, bucket long, seed binary, n binary, pos binary, doc binary, text_hash binary, ref_doc binary, ref_pos binary, text binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]
KINDS = {"seed": U64, "n": np.int32, "pos": np.int32, "doc": np.int64, "text_hash": np.int64, "ref_doc": np.int64, "ref_pos": np.int32}
SEGMENT, FACTOR, LEFT = 0, 1, 2
ZSTD = pa.Codec("zstd", 1)


def _row(kind, bucket, arrays: dict, texts=None):
    text = None
    if texts is not None:  # words hold no newline
        raw = b"\n".join(texts)
        text = len(raw).to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)
    cells = [pa.array([kind], pa.int32()), pa.array([bucket], pa.int64())]
    cells += [binary([arrays[c].astype(KINDS[c])]) if c in arrays else pa.array([None], pa.binary()) for c in NAMES[2:-1]]
    return pa.RecordBatch.from_arrays([*cells, pa.array([text], pa.binary())], names=NAMES)


def _arrays(batch, row, names) -> dict:
    return {c: np.frombuffer(column(batch, c)[row].as_buffer(), KINDS[c]) for c in names}


def _texts(batch, row) -> list[bytes]:
    raw = column(batch, "text")[row].as_buffer()
    return ZSTD.decompress(raw.slice(8), int.from_bytes(raw.slice(0, 8).to_pybytes(), "little"), asbytes=True).split(b"\n")


def _joined(rows: list[dict]) -> dict:
    return {c: np.concatenate([r[c] for r in rows]) for c in rows[0]}


def _factor_rows(found: dict, buckets: int):
    """found: the factors; each goes to the bucket of its document."""
    at = (mix(found["doc"].view(U64) ^ mix(found["text_hash"].view(U64))) % U64(buckets)).astype(np.int64)
    order, names, begin = by_bucket(at)
    for b, lo, hi in zip(names, begin[:-1], begin[1:]):
        yield _row(FACTOR, b, {c: x[order[lo:hi]] for c, x in found.items()})


def first_least(h: np.ndarray, m: int) -> np.ndarray:
    """The place of the least of h[i : i + m], the first on ties, for every i."""
    best, cover = np.arange(len(h)), 1
    while cover < m:
        step = min(cover, m - cover)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(h[a] <= h[b], a, b)
        cover += step
    return best


def segments(w: Words, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(text number, first word, windows, seed) of each run of windows of a text that have one seed."""
    many = np.maximum(w.count - width + 1, 0)
    text = np.repeat(np.arange(len(many)), many)
    if not len(text):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    start = np.arange(len(text)) + np.repeat(w.first[:-1] - np.cumsum(many) + many, many)
    at = np.arange(len(w.hash) - k + 1)
    h = mix(spans(WORD_BASE, w.hash, at, at + k) ^ U64(k))
    seed = first_least(h, width - k + 1)[start]
    begin = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1]))))
    return text[begin], start[begin], np.diff(np.append(begin, len(text))), h[seed[begin]]


def spelled(buf: np.ndarray, w: Words) -> tuple[bytes, np.ndarray]:
    """All words, each with one space after it, and where each begins (with the end)."""
    n = w.end - w.start + 1
    begin = np.concatenate(([0], np.cumsum(n)))
    out = np.append(buf, np.uint8(32))[np.arange(begin[-1]) - np.repeat(begin[:-1] - w.start, n)]
    out[begin[1:] - 1] = 32
    return out.tobytes(), begin


def _deal(width: int, k: int, buckets: int, source):
    """Segments of texts to their blocks. source gives (texts, doc, text_hash, words of the document before the text) of a batch."""

    def out(held, texts):
        a = _joined(held)
        order = np.lexsort((a["pos"], a["text_hash"], a["doc"]))
        a, texts = {c: x[order] for c, x in a.items()}, [texts[i] for i in order.tolist()]
        _, group, times = np.unique(a["seed"], return_inverse=True, return_counts=True)
        first, keep, twin = {}, np.ones(len(texts), bool), {}
        for i in np.flatnonzero(times[group] > 1).tolist():
            j = first.setdefault(texts[i], i)
            if i != j:
                keep[i], twin[i] = False, j
                twin.setdefault(j, i)
        if twin:
            i, j = (np.fromiter(x, np.int64, len(twin)) for x in (twin.keys(), twin.values()))
            yield from _factor_rows({"n": a["n"][i] + width - 1, "pos": a["pos"][i], "doc": a["doc"][i], "text_hash": a["text_hash"][i], "ref_doc": a["doc"][j], "ref_pos": a["pos"][j]}, buckets)
        kept = np.flatnonzero(keep)
        order, names, begin = by_bucket((mix(a["seed"][kept]) % U64(buckets)).astype(np.int64))
        for b, lo, hi in zip(names, begin[:-1], begin[1:]):
            at = kept[order[lo:hi]]
            yield _row(SEGMENT, b, {c: x[at] for c, x in a.items()}, [texts[i] for i in at.tolist()])

    def run(batches):
        held, texts, size = [], [], 0
        for some, doc, text_hash, before in (s for batch in batches for s in source(batch)):
            for row, buf, off in slices(some):
                w = Words(buf, off, False)
                text, lo, n, seed = segments(w, width, k)
                if not len(n):
                    continue
                raw, begin = spelled(buf, w)
                hi = lo + n + width - 1
                texts += [raw[x : y - 1] for x, y in zip(begin[lo].tolist(), begin[hi].tolist())]
                own = row + text
                held.append({"seed": seed, "n": n, "pos": lo - w.first[text] + before[own], "doc": doc[own], "text_hash": text_hash[own]})
                size += int(n.sum())
                if size >= CHUNK:
                    yield from out(held, texts)
                    held, texts, size = [], [], 0
        if held:
            yield from out(held, texts)

    return run


def _of_documents(batch):
    yield column(batch, "text"), ids_of(column(batch, "doc_id")), ids_of(column(batch, "text_hash")), np.zeros(batch.num_rows, np.int64)


def _of_segments(batch):
    for row in range(batch.num_rows):
        a = _arrays(batch, row, ("pos", "doc", "text_hash"))
        yield pa.array(_texts(batch, row), pa.large_binary()).cast(pa.large_string()), a["doc"], a["text_hash"], a["pos"]


class Index:
    """All suffixes of some texts, in order: ranks of runs of words by prefix doubling. Each text ends in a sign of its own."""

    def __init__(self, texts: list[bytes], width: int):
        pieces = pc.split_pattern(pa.array(texts, pa.large_binary()).cast(pa.large_string()), " ")
        words, flat = np.diff(pieces.offsets.to_numpy()).astype(np.int64), pieces.flatten().dictionary_encode()
        self.width = width
        self.end = np.cumsum(words + 1) - 1  # the sign's place
        self.begin = self.end - words
        self.word = np.empty(int(words.sum()) + len(texts), np.int64)
        inside = np.ones(len(self.word), bool)
        inside[self.end] = False
        self.word[inside] = flat.indices.to_numpy()
        self.word[~inside] = len(flat.dictionary) + np.arange(len(texts))
        rank, cover = self._ranked(self.word, np.zeros(len(self.word), np.int64), 0), 1
        while 2 * cover <= width:
            rank, cover = self._ranked(rank, rank, cover), 2 * cover
        window = self._ranked(rank, rank, width - cover) if cover < width else rank
        self.text = np.repeat(np.arange(len(texts)), words + 1)
        whole = np.flatnonzero(np.arange(len(self.word)) + width <= self.end[self.text])
        many = np.bincount(window, minlength=1)[window[whole]] > 1
        self.places = whole[many]  # windows that start at two places or more, in order
        after = np.append(rank, 0)[np.minimum(self.places + width, len(rank))]
        order = np.lexsort((self.places, after, window[self.places]))
        sorted_, same = self.places[order], window[self.places[order]]
        self.next, self.last = np.full(len(order), -1), np.full(len(order), -1)
        pairs = same[1:] == same[:-1]
        self.next[order[:-1][pairs]] = sorted_[1:][pairs]
        self.last[order[1:][pairs]] = sorted_[:-1][pairs]

    @staticmethod
    def _ranked(a, b, shift):
        """Ranks of the pairs (a[i], b[i + shift])."""
        key = a * (int(b.max(initial=0)) + 2)
        key[: len(b) - shift] += b[shift:] + 1
        return np.unique(key, return_inverse=True)[1]

    def match(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Words that the texts at both places share from there on; 0 without another place. Signs never agree."""
        n = np.where(other >= 0, self.width, 0)
        go = np.flatnonzero(n)
        while len(go):
            go = go[self.word[at[go] + n[go]] == self.word[other[go] + n[go]]]
            n[go] += 1
        return n

    def factors(self) -> tuple[np.ndarray, ...]:
        """The greedy parse of every text: (place, words, place of the match)."""
        found, now = [], np.searchsorted(self.places, self.begin)  # the first window of each text that occurs elsewhere
        text = np.arange(len(self.begin))
        while True:
            go = now < len(self.places)
            go[go] = self.places[now[go]] < self.end[text[go]]
            now, text = now[go], text[go]
            if not len(now):
                break
            at = self.places[now]
            a, b = self.match(at, self.next[now]), self.match(at, self.last[now])
            n = np.maximum(a, b)
            found.append((at, n, np.where(a > b, self.next[now], self.last[now])))
            now = np.searchsorted(self.places, at + n - self.width + 1)  # the first window over the factor's end
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def settle(a: dict, texts: list[bytes], width: int) -> dict:
    """The factors of a block's segments; a has their arrays."""
    order = np.lexsort((a["pos"], a["text_hash"], a["doc"]))
    a, texts = {c: x[order] for c, x in a.items()}, [texts[i] for i in order.tolist()]
    first, twin, distinct = {}, {}, []
    for i, t in enumerate(texts):
        j = first.setdefault(t, i)
        if i == j:
            distinct.append(i)
        else:
            twin[i] = j
            twin.setdefault(j, i)
    i, j = (np.fromiter(x, np.int64, len(twin)) for x in (twin.keys(), twin.values()))
    n, skip, ref_skip = a["n"][i] + width - 1, np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    distinct = np.array(distinct, np.int64)
    _, group, times = np.unique(a["seed"][distinct], return_inverse=True, return_counts=True)
    distinct = distinct[times[group] > 1]
    if len(distinct):
        index = Index([texts[x] for x in distinct.tolist()], width)
        at, words, other = index.factors()
        own, ref = index.text[at], index.text[other]
        i, j, n = np.append(i, distinct[own]), np.append(j, distinct[ref]), np.append(n, words)
        skip, ref_skip = np.append(skip, at - index.begin[own]), np.append(ref_skip, other - index.begin[ref])
    return {"n": n, "pos": a["pos"][i] + skip, "doc": a["doc"][i], "text_hash": a["text_hash"][i], "ref_doc": a["doc"][j], "ref_pos": a["pos"][j] + ref_skip}


def _blocks(width: int, buckets: int, limit: int, last: bool):
    """Rows sorted by bucket: blocks are settled one by one; what is too large for one goes on as LEFT."""
    names = ("seed", "n", "pos", "doc", "text_hash")

    def done(held):
        a = _joined([x for x, _ in held])
        _, group, times = np.unique(a["seed"], return_inverse=True, return_counts=True)
        many = np.flatnonzero(times[group] > 1)
        if len(many):
            texts = [t for _, ts in held for t in ts()]
            found = settle({c: x[many] for c, x in a.items()}, [texts[i] for i in many.tolist()], width)
            if len(found["n"]):
                yield from _factor_rows(found, buckets)

    def compact(held):
        """Of equal windows (the last round has one a segment) the first stays: the others are settled."""
        a, texts = _joined([x for x, _ in held]), [t for _, ts in held for t in ts()]
        first, twin = {}, {}
        for i, t in enumerate(texts):
            j = first.setdefault(t, i)
            if i != j:
                twin[i] = j
                twin.setdefault(j, i)
        i, j = (np.fromiter(x, np.int64, len(twin)) for x in (twin.keys(), twin.values()))
        rows = _factor_rows({"n": a["n"][i] + width - 1, "pos": a["pos"][i], "doc": a["doc"][i], "text_hash": a["text_hash"][i], "ref_doc": a["doc"][j], "ref_pos": a["pos"][j]}, buckets) if twin else ()
        stay = np.fromiter(first.values(), np.int64, len(first))
        kept = list(first)
        return [({c: x[stay] for c, x in a.items()}, lambda: kept)], rows

    def run(batches):
        now, held, words, over = None, [], 0, False
        for batch in batches:
            passed = column(batch, "kind").to_numpy() == FACTOR
            if passed.any():
                yield batch.filter(pa.array(passed))
            buckets_of = column(batch, "bucket").to_numpy()
            for row in np.flatnonzero(~passed).tolist():
                if buckets_of[row] != now:
                    if held:
                        yield from done(held)
                    now, held, words, over = buckets_of[row], [], 0, False
                a = _arrays(batch, row, names)
                held.append((a, lambda b=batch.slice(row, 1): _texts(b, 0)))
                words += int((a["n"] + width - 1).sum())
                if last and words > limit:
                    held, rows = compact(held)
                    yield from rows
                    words = int((held[0][0]["n"] + width - 1).sum()) // 2
                elif words > limit or over:
                    over = True
                    for x, ts in held:
                        yield _row(LEFT, 0, x, ts())
                    held = []
        if held:
            yield from done(held)

    return run


NO_ID = np.iinfo(np.int64).min


def glued(a: dict, width: int) -> tuple[dict, np.ndarray]:
    """The factors of documents, in order of (doc, text_hash, place), of one place the longest; those that go on where the one
    before was, at one place of the reference, are one. Also where each document begins (with the end)."""
    order = np.lexsort((a["ref_pos"], a["ref_doc"], -a["n"], a["pos"], a["text_hash"], a["doc"]))
    a = {c: x[order].astype(np.int64) for c, x in a.items()}
    new = lambda *cols: np.concatenate(([True], np.logical_or.reduce([a[c][1:] != a[c][:-1] for c in cols])))
    keep = new("doc", "text_hash", "pos")
    a = {c: x[keep] for c, x in a.items()}
    a["shift"] = a["ref_pos"] - a["pos"]
    end = a["pos"] + a["n"]
    head = new("doc", "text_hash", "ref_doc", "shift")
    head[1:] |= a["pos"][1:] > end[:-1] - width + 1
    begin = np.flatnonzero(head)
    out = {c: x[begin] for c, x in a.items()}
    out["n"] = np.maximum.reduceat(end, begin) - out["pos"]
    first = np.concatenate(([True], (out["doc"][1:] != out["doc"][:-1]) | (out["text_hash"][1:] != out["text_hash"][:-1])))
    return out, np.append(np.flatnonzero(first), len(begin))


def _documents(width: int):
    """Rows of factors sorted by bucket to one row a document."""
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))

    def done(held):
        a, at = glued(_joined(held), width)
        for n in range(0, len(at) - 1, 2000):
            rows = [(None if a["doc"][lo] == NO_ID else int(a["doc"][lo]), int(a["text_hash"][lo]), a["pos"][lo:hi], a["n"][lo:hi], [None if x == NO_ID else x for x in a["ref_doc"][lo:hi].tolist()], a["ref_pos"][lo:hi]) for lo, hi in zip(at[n : n + 2000], at[n + 1 : n + 2001])]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["fdoc", "fhash", "start", "words", "ref_doc", "ref_start"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for row, b in enumerate(column(batch, "bucket").to_pylist()):
                if b != now and held:
                    yield from done(held)
                    held = []
                now = b
                held.append(_arrays(batch, row, ("n", "pos", "doc", "text_hash", "ref_doc", "ref_pos")))
        if held:
            yield from done(held)

    return run


def _kept(batches):
    for batch in batches:
        n, removed, kept = [], [], []
        for text, start, size in zip(column(batch, "text"), column(batch, "start").to_pylist(), column(batch, "words").to_pylist()):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n.append(len(words))
            if start:
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, start, 1)
                np.add.at(step, np.add(start, size), -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
            removed.append(n[-1] - len(words))
            kept.append(b" ".join(words))
        lists = [column(batch, k) for k in ("start", "words", "ref_doc", "ref_start")]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *lists], names=["doc_id", "n_words", "n_removed", "kept", "start", "words", "ref_doc", "ref_start"])


def remove_repeats(docs: DataFrame, width: int = 35, block_words: int = BLOCK_WORDS, limit: int | None = None, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space), and the
    factors as parallel arrays start, words, ref_doc, ref_start (null where there is none). A block holds about block_words
    words, and never more than limit (8 times as many by default)."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    limit = limit or 8 * block_words
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (2 * block_words)))  # a word is some six bytes, and lies in three segments
    parts = reducers(spark, buckets)
    sorted_ = lambda rows: rows.repartition(parts, "bucket").sortWithinPartitions("bucket")
    left, source, found = docs.filter("text is not null"), _of_documents, None
    for k in (*(s for s in seeds if s < width), width):
        dealt = sorted_(left.mapInArrow(_deal(width, k, buckets, source), ROW))
        settled = materialize(dealt.mapInArrow(_blocks(width, buckets, limit, k == width), ROW))
        one = settled.filter(F.col("kind") == FACTOR)
        found = one if found is None else found.unionByName(one)
        left, source = settled.filter(F.col("kind") == LEFT), _of_segments
        if left.isEmpty():
            break
    kind = "fdoc long, fhash long, start array<int>, words array<int>, ref_doc array<long>, ref_start array<int>"
    factors = materialize(sorted_(found).mapInArrow(_documents(width), kind))
    both = docs.join(factors.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("fdoc")) & (F.col("text_hash") == F.col("fhash")), "left")
    out = "doc_id long, n_words long, n_removed long, kept string, start array<int>, words array<int>, ref_doc array<long>, ref_start array<int>"
    return both.select("doc_id", "text", "start", "words", "ref_doc", "ref_start").mapInArrow(_kept, out)
