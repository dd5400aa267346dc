"""N-gram Jaccard join by a size-aware heavy-light scheme.

Sets are the distinct word shingles of a text. Two sets link when intersection * 100 >= percent * union.

1. Texts whose sets are equal become one node (a 128-bit digest of the set). A task sends the shingles of a node once for each
   chunk of its rows, so a group of copies of any size costs a set a chunk.
2. Shingles go to buckets in packed blocks. A bucket counts in how many nodes each shingle is; those found in one node
   only go no further, since they are in no intersection. The others go back to their node with that count.
3. In a node's set ordered by (count, hash), at least one of the first n - ceil(percent n) + 1 shingles is shared with
   any partner. If so many are the node's alone, it has none.
4. Light sets (n <= boundary) are keyed by each subset of the sizes that a light partner must share; heavy sets scan the
   inverted lists of their prefix. The boundary is the size up to which enumerating costs less than scanning, by the
   counts of this corpus.
5. Within a list only links between different components matter. Two rounds join each node to the pivot that it
   meets in most lists (first the set with the least of its own, as the original in a family of near copies has; then any); then the pairs of a list that are still in different components are verified. No pair is
   left out but those that counting rules out: sets share no more than what either shares with anything, and in the list of
   the first shingle that they share, no more than what either has left from there on. So of a set that meets larger ones,
   only its first n - need(n, n) + 1 places are searched, and a pair is kept at a place of both only if enough is left
   in both. A group of near copies makes rows in proportion to its size, not to its square.

Null text counts as empty. Empty sets link with nothing. A null doc_id takes part but is never a component_id. Repeated
doc_ids are separate rows of the result. Only doc_id and text are read; other columns don't matter.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_BASE, Words, binary, bucket_runs, by_bucket, column, components, ids_of, materialize, mix, narrow, pick, reducers, slices, spans, unpack, widen

#: Largest light set that is ever considered; beyond it, subsets outnumber any list. It changes no result: larger sets are heavy.
MAX_LIGHT = 12
#: Shingles a bucket should hold (8 bytes each, and as much again a few times while it is sorted).
BUCKET = 1_000_000


def need(n: int, m: int, percent: int) -> int:
    """Least intersection of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each distinct shingle, in order of both. A shorter text is one shingle."""
    count, first = words.count, words.first
    many = np.maximum(count - width + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), many)
    lo = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    h = spans(WORD_BASE, words.hash, lo, np.minimum(lo + width, first[1:][text]))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[keep], h[keep]


def digests(text: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.bincount(text, minlength=rows)
    at = np.concatenate(([0], np.cumsum(n)))
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h ^ U64(salt)))))
        sums.append(mix(total[at[1:]] - total[at[:-1]]).view(np.int64))
    return n, *sums


def _sketch(width):
    def run(batches):
        for batch in batches:
            rows, ids, texts = column(batch, "row_id"), column(batch, "doc_id"), column(batch, "text")
            for row, buf, off in slices(texts):
                n, a, b = digests(*shingles(Words(buf, off, True), width), len(off) - 1)
                yield pa.RecordBatch.from_arrays([rows.slice(row, len(n)), ids.slice(row, len(n)), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["row_id", "doc_id", "n_shingles", "node", "check"])

    return run


def _to_buckets(width, buckets, chunk=1 << 19):
    """Rows (bucket, hashes, owners, sizes, counts): hashes by owner, counts of them by owner."""

    def out(held):
        h, node, n = (np.concatenate(x) for x in zip(*held))
        order, found, at = by_bucket((h >> U64(40)).astype(np.int64) % buckets)
        h, node, n = h[order], node[order], n[order]
        rows = []
        for lo, hi in zip(at[:-1], at[1:]):
            change = np.flatnonzero(np.concatenate(([True], node[lo + 1 : hi] != node[lo : hi - 1])))
            rows.append((h[lo:hi], node[lo:hi][change], n[lo:hi][change], np.diff(np.append(change, hi - lo)).astype(np.int32)))
        h, node, n, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), binary(h), binary(node), narrow(n), narrow(c)], names=["bucket", "h", "node", "n", "c"])

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            for _, buf, off in slices(column(batch, "text")):
                text, h = shingles(Words(buf, off, True), width)
                n, node, _ = digests(text, h, len(off) - 1)
                new = np.zeros(len(node), bool)  # of copies in a chunk, one goes on
                new[[i for i, x in enumerate(node.tolist()) if not (x in seen or seen.add(x))]] = True
                text, h = text[new[text]], h[new[text]]
                held.append((h, node[text], n[text].astype(np.int32)))
                size += len(h)
                if size >= chunk:
                    yield out(held)
                    held, size, seen = [], 0, set()
        if size:
            yield out(held)

    return run


def _shared(buckets):
    """From a bucket's blocks to rows (bucket of nodes, ...) of the shingles that at least two nodes have."""

    def one(batches):
        h, node = unpack(batches, ("h", U64), ("node", np.int64))
        n, c = (widen(batches, x, "node") for x in ("n", "c"))
        owner = np.repeat(np.arange(len(node)), c)
        order = np.lexsort((node[owner], h))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)  # copies from several chunks count once
        new[1:] = (h[1:] != h[:-1]) | (node[owner[1:]] != node[owner[:-1]])
        h, owner = h[new], owner[new]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(begin, len(h)))
        df = np.repeat(size, size).astype(np.int32)
        keep = df > 1
        h, df, owner = h[keep], df[keep], owner[keep]
        order, found, at = by_bucket((mix(node[owner].view(U64)) % U64(buckets)).astype(np.int64))
        h, df, owner = h[order], df[order], owner[order]
        for b, lo, hi in zip(found, at[:-1], at[1:]):
            o, inner = owner[lo:hi], np.argsort(owner[lo:hi], kind="stable")
            own, cnt = np.unique(o, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), binary([h[lo:hi][inner]]), narrow([df[lo:hi][inner]]), binary([node[own]]), narrow([n[own]]), narrow([cnt])], names=["bucket", "h", "df", "node", "n", "c"])

    def run(batches):
        for bucket in bucket_runs(batches):
            yield from one(bucket)

    return run


def _sets(percent):
    """From the blocks of a bucket of nodes to one row a node that can have a partner."""

    def one(batches):
        h, node = unpack(batches, ("h", U64), ("node", np.int64))
        df, n, c = widen(batches, "df", "h"), widen(batches, "n", "node"), widen(batches, "c", "node")
        node, n = np.repeat(node, c), np.repeat(n, c)
        order = np.lexsort((h, df, node))
        h, df, node, n = h[order], df[order], node[order], n[order]
        begin = np.append(np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(h) else [], len(h)).astype(np.int64)
        rows = []
        for lo, hi in zip(begin[:-1], begin[1:]):
            left = prefix_length(int(n[lo]), percent) - (int(n[lo]) - (hi - lo))
            if left > 0:
                left = min(left, hi - lo)
                rows.append((int(node[lo]), int(n[lo]), np.sort(h[lo:hi]).tobytes(), h[lo : lo + left].tobytes(), int(df[lo : lo + left].sum())))
                if len(rows) == 2000:
                    yield _set_rows(rows)
                    rows = []
        if rows:
            yield _set_rows(rows)

    def run(batches):
        for bucket in bucket_runs(batches):
            yield from one(bucket)

    return run


def _set_rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["node", "n", "shared", "prefix", "scan"])


def subset_sizes(n: int, percent: int, most: int) -> list[int]:
    """The intersections that a light set of n must reach with the light sizes it can link to."""
    return sorted({need(n, m, percent) for m in range(1, most + 1) if 100 * min(n, m) >= percent * max(n, m)})


def _keys(percent, boundary):
    def run(batches):
        for batch in batches:
            key, node, size, held, place = [], [], [], [], []
            for i, n, s, p in zip(*(column(batch, x).to_pylist() for x in ("node", "n", "shared", "prefix"))):
                own, at = [np.frombuffer(p, U64)], [n - len(s) // 8 + np.arange(len(p) // 8)]
                if n <= boundary:
                    tokens = np.frombuffer(s, U64)
                    own += [mix(np.array([hash_subset(x, c) for x in combinations(tokens.tolist(), c)], U64)) for c in subset_sizes(n, percent, boundary) if c <= len(tokens)]
                    at += [np.zeros(len(x), np.int64) for x in own[1:]]  # a subset is enough by itself
                    if 100 * n < percent * (boundary + 1):  # no heavy partner
                        own, at = own[1:], at[1:]
                own = np.concatenate(own) if own else np.zeros(0, U64)
                key.append(own)
                node.append(np.full(len(own), i, np.int64))
                size.append(np.full(len(own), n, np.int32))
                held.append(np.full(len(own), len(s) // 8, np.int32))
                place.append(np.concatenate(at).astype(np.int32) if at else np.zeros(0, np.int32))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (node, size, held, place))], names=["key", "node", "n", "s", "i"])

    return run


def hash_subset(tokens, c: int) -> int:
    out = c + 1
    for t in tokens:
        out = (out * WORD_BASE + t) % (1 << 64)
    return out


def _verified(percent):
    def run(batches):
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(column(batch, k).to_pylist() for k in ("na", "nb", "sa", "sb"))):
                both = np.concatenate((np.frombuffer(x, U64), np.frombuffer(y, U64)))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([column(batch, k).filter(pa.array(good, pa.bool_())) for k in ("a", "b")], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    return pairs.select("a", "b").join(b, "b").join(a, "a").mapInArrow(_verified(percent), "a long, b long")


def boundary_by_cost(sets: DataFrame, percent: int) -> int:
    """The light sizes are those up to here: of all boundaries, the cheapest by rows made (subsets enumerated, or
    entries of the inverted lists scanned)."""
    by_size = {r["n"]: (r["sets"], r["scan"]) for r in sets.filter(F.col("n") <= MAX_LIGHT).groupBy("n").agg(F.count("*").alias("sets"), F.sum("scan").alias("scan")).collect()}
    cost = {x: sum(c * sum(comb(n, k) for k in subset_sizes(n, percent, x)) if n <= x else scan for n, (c, scan) in by_size.items()) for x in range(MAX_LIGHT + 1)}
    return min(cost, key=lambda x: (cost[x], x))


def jaccard_components(docs: DataFrame, **how) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id in reach; null for a row whose
    component has no doc_id)."""
    return component_rows(docs, **how).select("doc_id", "n_shingles", "component_id")


def component_rows(docs: DataFrame, width: int = 5, percent: int = 75, rounds: int = 2) -> DataFrame:
    """jaccard_components with row_id (of the row in docs), and keep_row, that of the first row of the component by
    (doc_id, nulls last, row_id). A row with an empty set is the first of its own."""
    docs = pick(docs, "doc_id", "text")
    return _components(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), width, percent, rounds)


def _components(numbered: DataFrame, width: int, percent: int, rounds: int = 2) -> DataFrame:
    spark, docs = numbered.sparkSession, numbered
    sketch = materialize(numbered.mapInArrow(_sketch(width), "row_id long, doc_id long, n_shingles long, node long, check long"))
    class_key = ["node", "check", "n_shingles"]
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_id")
    classes = materialize(sketch.filter("n_shingles > 0").groupBy(*class_key).agg(F.min(rank).alias("least")))
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0

    buckets = max(1, -(-total // BUCKET))
    parts = reducers(spark, buckets)
    dealt = lambda rows: rows.repartition(parts, "bucket").sortWithinPartitions("bucket")
    blocks = docs.select("text").mapInArrow(_to_buckets(width, buckets), "bucket long, h binary, node binary, n binary, c binary")
    shared = dealt(blocks).mapInArrow(_shared(buckets), "bucket long, h binary, df binary, node binary, n binary, c binary")
    sets = materialize(dealt(shared).mapInArrow(_sets(percent), "node long, n long, shared binary, prefix binary, scan long"))

    boundary = boundary_by_cost(sets, percent)
    keys = sets.mapInArrow(_keys(percent, boundary), "key long, node long, n int, s int, i int")
    many = keys.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    keys = materialize(keys.join(many, "key"))
    least = f"ceil({percent} * (n + m) / {100 + percent})"  # shingles that linked sets share; no more than either shares with anything
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m) and least(s, t) >= {least}"
    found, roots = None, None
    for turn in range(rounds):
        now = keys.withColumn("root", F.col("node")) if roots is None else keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pivot = now.groupBy("key").agg(F.min_by(F.struct("node", "n", "s", "root"), F.struct((F.col("n") - F.col("s")) / F.col("n") if turn == 0 else F.lit(0.0), F.xxhash64("node", F.lit(turn)))).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        met = now.join(pivot.select("key", F.col("p.node").alias("p"), F.col("p.n").alias("m"), F.col("p.s").alias("t"), F.col("p.root").alias("proot")), "key").filter(f"root <> proot and {fits}")
        met = met.groupBy("node", "p").agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("p", F.struct("k", "p")).alias("p"))
        links = _links(met.select(F.col("p").alias("a"), F.col("node").alias("b")), sets, percent)
        found = materialize(links if found is None else links.unionByName(found))
        roots = components(found)
        roots = materialize(roots)
    now = keys.join(roots, "node", "left").select("key", "node", "n", "s", "i", F.coalesce("root", "node").alias("root"))
    mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    now = materialize(now.join(mixed, "key"))
    other = now.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("i").alias("j"), F.col("root").alias("oroot"))
    other = other.filter(f"m - j >= ceil({percent} * 2 * m / {100 + percent})")  # its partners are as large or larger
    larger = "(m < n or m = n and node < other)"
    rest = now.join(other, "key").filter(f"{larger} and root <> oroot and {fits} and least(n - i, m - j) >= {least}")
    rest = rest.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    found = materialize(found.unionByName(_links(rest, sets, percent)))
    roots = materialize(components(found))

    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(least, "root").select(*class_key, F.col("first.doc_id").alias("component_id"), F.col("first.row_id").alias("keep_row"))
    columns = ["row_id", "doc_id", "n_shingles", "component_id", "keep_row"]
    linked = sketch.filter("n_shingles > 0").join(named, class_key).select(*columns)
    alone = sketch.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("keep_row", F.col("row_id")).select(*columns)
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component of docs, with all columns, whatever their names: that of the smallest doc_id (nulls last), of equal ones
    the first; rows with empty sets all stay. Rows are written with a number once, and all steps read that table."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("doc")))
    stays = _components(numbered.select("row_id", "doc.doc_id", "doc.text"), width, percent).filter("row_id = keep_row").select("row_id")
    return numbered.join(stays, "row_id", "left_semi").select("doc.*")
