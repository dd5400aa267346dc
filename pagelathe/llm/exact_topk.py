"""Exact top-k search with vector-approximation files.

Two tables are written once. The vector file has a row for each vector, with its exact components. The approximation file has the
same vectors in blocks, each component as the number of its cell (one byte) on the block's own grid.

1. Query blocks meet approximation blocks, tile by tile. The cells alone give a lower and an upper bound of each inner product,
   one matrix product in single precision with its rounding added to the bounds. A task carries each query's k-th best lower bound
   from block to block, and drops what stays under it.
2. Of what is left, each query reads the exact vectors of its 2k best upper bounds. Their k-th best score is a new bound.
3. Only vectors whose upper bound is not under it are read besides. What was never read cannot be among the k, not even by a tie.

Queries are rows of the same table (by default every vec_id that `every` divides). They are dealt to tiles of at most TILE queries,
so no task holds the query set; vectors and queries never meet one row by one row.

Components become floor(scale * x) as integers. Vectors that are null, or hold a null or non-finite component, take no part, as
query or as candidate; nor do rows without vec_id. Only vectors of the query's length are compared; those of length 0
have product 0. Rows with the query's own vec_id are no candidates; other rows may repeat and all count. Of rows that share a query's vec_id the
smallest vector, component by component, is the query. Products are exact integers of any size; a score beyond 64 bits is
reported as the nearest 64-bit integer, but ranked by its exact value.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, column, materialize, pick

CELLS, VECTORS, QUERIES, TILE = 256, 2048, 256, 8192


def integers(vectors: pa.Array, scale: float) -> list[np.ndarray | None]:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(flat * scale)
    for n, lo, hi in zip(size, at[:-1], at[1:]):
        v = whole[lo:hi]
        out.append(v if n >= 0 and np.isfinite(v).all() else None)
    return out


def _exact(scale):
    """The vector file: components as doubles that are whole numbers."""

    def run(batches):
        for batch in batches:
            v = integers(column(batch, "embedding"), scale)
            good = pa.array([x is not None for x in v])
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id").filter(good), pa.array([len(x) for x in v if x is not None], pa.int32()), pa.array([x for x in v if x is not None], pa.list_(pa.float64()))], names=["vec_id", "dim", "v"])

    return run


class Cells:
    """The approximation of a block of vectors: a grid of `cells` equal cells a dimension between its extremes."""

    def __init__(self, v: np.ndarray, cells: int = CELLS):
        self.low = v.min(0) if len(v) else np.zeros(v.shape[1])
        with np.errstate(over="ignore"):
            self.width = np.maximum(1.0, np.ceil(((v.max(0) if len(v) else self.low) / cells - self.low / cells + 1 / cells) * (1 + 1e-12)))
        self.code = np.clip(np.floor((v - self.low) / self.width), 0, cells - 1).astype(np.uint8)

    @classmethod
    def read(cls, low, width, code):
        self = cls.__new__(cls)
        self.low, self.width, self.code = low, width, code
        return self

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, vectors): the inner product is between these. Rounding is added on both sides; what overflows is unbounded."""
        with np.errstate(over="ignore", invalid="ignore"):
            step = q * self.width
            top = np.abs(step).max(1, keepdims=True) if step.shape[1] else np.zeros((len(q), 1))
            unit = np.where(top > 0, top, 1.0)
            near = (step / unit).astype(np.float32) @ self.code.T.astype(np.float32)
            base = near.astype(np.float64) * unit + (q @ self.low)[:, None]
            n = q.shape[1] + 4
            error = n * 2.0**-23 * np.abs(step).sum(1, keepdims=True) * 256 + n * 2.0**-50 * (np.abs(q) @ np.abs(self.low))[:, None]
            span = self.width * (1 + 2.0**-40)
            low = base + (np.minimum(q, 0) @ span)[:, None] - error
            high = base + (np.maximum(q, 0) @ span)[:, None] + error
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def _approximated(cells, each):
    """The approximation file: a row for each block of vectors of one length."""
    names = ["dim", "rows", "ids", "low", "width", "code"]

    def run(batches):
        held = defaultdict(list)

        def out(dim):
            rows, ids, vectors = zip(*held.pop(dim))
            c = Cells(np.stack(vectors).reshape(len(ids), dim), cells)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(binary([x]) for x in (np.array(rows, np.int64), np.array(ids, np.int64), c.low, c.width, c.code))], names=names)

        for batch in batches:
            v = column(batch, "v")
            flat, size = v.flatten().to_numpy(), v.value_lengths().to_numpy()
            at = np.concatenate(([0], np.cumsum(size)))
            for row, i, n, lo in zip(column(batch, "row_id").to_pylist(), column(batch, "vec_id").to_pylist(), size.tolist(), at):
                held[n].append((row, i, flat[lo : lo + n]))
                if len(held[n]) == each:
                    yield out(n)
        for dim in list(held):
            yield out(dim)

    return run


def _packed(each):
    """Query blocks (dim, q_ids, q_vectors)."""

    def run(batches):
        held = defaultdict(list)

        def out(dim):
            ids, vectors = zip(*held.pop(dim))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), binary([np.array(ids, np.int64)]), binary([np.array(vectors, np.float64)])], names=["dim", "q_ids", "q_vectors"])

        for batch in batches:
            for i, v in zip(column(batch, "vec_id").to_pylist(), column(batch, "v").to_pylist()):
                held[len(v)].append((i, v))
                if len(held[len(v)]) == each:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return run


def _bounded(k):
    """Candidates (query_id, row_id, vec_id, low, high) of each meeting of blocks."""
    names = ("dim", "q_ids", "q_vectors", "rows", "ids", "low", "width", "code")
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64, np.float64, np.uint8)

    def run(batches):
        best: dict[bytes, np.ndarray] = {}  # of a tile's query blocks: the k best lower bounds of each query so far
        for batch in batches:
            for row in range(batch.num_rows):
                dim, *got = (column(batch, n)[row] for n in names)
                qi, qv, rows, ids, low, width, code = (np.frombuffer(x.as_buffer(), t) for x, t in zip(got, kinds))
                dim = dim.as_py()
                lows, highs = Cells.read(low, width, code.reshape(len(ids), dim)).bounds(qv.reshape(len(qi), dim))
                own = qi[:, None] == ids[None, :]
                lows[own] = -np.inf
                key = qi.tobytes()
                seen = best.get(key, np.full((len(qi), k), -np.inf))
                seen = -np.sort(-np.concatenate((seen, lows), 1), 1)[:, :k]
                best[key] = seen
                q, v = np.nonzero((highs >= seen[:, -1:]) & ~own)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qi[q], rows[v], ids[v], lows[q, v], highs[q, v])], names=["query_id", "row_id", "vec_id", "low", "high"])

    return run


def _scored(batches):
    """(query_id, vec_id, exact: a text in the order of the exact scores, score: cut to 64 bits)."""
    for batch in batches:
        whole = [sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(column(batch, "q").to_pylist(), column(batch, "v").to_pylist())]
        score = [max(-(2**63), min(2**63 - 1, s)) for s in whole]
        yield pa.RecordBatch.from_arrays([column(batch, "query_id"), column(batch, "vec_id"), pa.array(map(_sortable, whole), pa.string()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "exact", "score"])


def _sortable(s: int) -> str:
    """Integers of any size as text in the same order: sign, number of digits, digits (nines' complement if negative)."""
    digits = str(abs(s))
    if s >= 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999999 - len(digits):06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _read(wanted: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact scores of the wanted (query_id, row_id): only their vectors are read from the vector file."""
    met = wanted.select("query_id", "row_id").join(vectors.select("row_id", "vec_id", "v"), "row_id")
    met = met.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return met.select("query_id", "vec_id", "q", "v").mapInArrow(_scored, "query_id long, vec_id long, exact string, score long")


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(found, read): each query's k best (query_id, rank from 1, vec_id, score; ties go to the smaller vec_id), and the pairs
    (query_id, vec_id) whose exact vectors were read for it."""
    spark = vectors.sparkSession
    vectors = pick(vectors, "vec_id", "embedding").filter("vec_id is not null and embedding is not null").withColumn("embedding", F.col("embedding").cast("array<double>"))
    exact = vectors.mapInArrow(_exact(scale), "vec_id long, dim int, v array<double>").withColumn("row_id", F.monotonically_increasing_id())
    exact = materialize(exact)
    blocks = materialize(exact.mapInArrow(_approximated(cells, VECTORS), "dim int, rows binary, ids binary, low binary, width binary, code binary"))
    queries = materialize(exact.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v")).withColumn("n", F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))).filter("n = 1").drop("n"))

    tiles = max(1, -(-queries.count() // TILE))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = queries.mapInArrow(_packed(QUERIES), "dim int, q_ids binary, q_vectors binary").withColumn("tile", F.pmod(F.xxhash64("q_ids"), F.lit(tiles)).cast("int"))
    packed = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("rows"), F.lit(parts)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = dealt.join(packed.hint("shuffle_hash"), ["dim", "part", "tile"]).select("dim", "q_ids", "q_vectors", "rows", "ids", "low", "width", "code")
    bounded = materialize(met.mapInArrow(_bounded(k), "query_id long, row_id long, vec_id long, low double, high double"))

    by = Window.partitionBy("query_id")
    floor = bounded.withColumn("n", F.row_number().over(by.orderBy(F.desc("low")))).filter(F.col("n") <= k).groupBy("query_id").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    floor = floor.select("query_id", F.when(F.col("n") == k, F.col("least")).otherwise(float("-inf")).alias("least"))
    likely = materialize(bounded.join(floor, "query_id").filter("high >= least").select("query_id", "row_id", "high", F.row_number().over(by.orderBy(F.desc("high"), "row_id")).alias("n")))
    first = materialize(_read(likely.filter(F.col("n") <= 2 * k), exact, queries))
    kth = first.withColumn("n", F.row_number().over(by.orderBy(F.desc("exact")))).filter(F.col("n") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    slack = F.abs("kth") * 2.0**-50  # kth is rounded to a double, and cut to 64 bits
    rest = likely.filter(F.col("n") > 2 * k).join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.abs("kth") >= 2.0**62) | (F.col("high") >= F.col("kth") - slack))
    read = first.unionByName(materialize(_read(rest, exact, queries)))
    found = read.withColumn("rank", F.row_number().over(by.orderBy(F.desc("exact"), "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return found, read.select("query_id", "vec_id")


def top_k(vectors: DataFrame, **how) -> DataFrame:
    """Each query's k best: query_id, rank (from 1), vec_id, score."""
    return search(vectors, **how)[0]
