"""What the training-data operators share: the cluster's working folder, word and shingle hashing over Arrow
buffers, and block-packed exchanges (a few wide rows in place of one row for each word)."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the polynomial hashes (mod 2**64), one for bytes in a word and one for words in a sequence.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Text bytes hashed in one go; bounds the memory of the numpy temporaries.
SLICE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where the session names none and has but one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="pagelathe-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


#: Paths of the working tables that this process has written.
MADE: list[str] = []


def discard(spark: SparkSession, paths: list[str], needed: DataFrame) -> None:
    """Deletes working tables, but for those that `needed` reads."""
    read = {f.rsplit("/", 2)[-2] for f in needed.inputFiles()}  # each table's folder has a name of its own
    for path in paths:
        if path.rsplit("/", 1)[-1] not in read:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Spark then drops the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs
    only the tasks that it was running. Shuffle files of the write go when it ends, the table when the driver's file system closes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagelathe-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    MADE.append(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Most tasks of a shuffle; beyond, a task takes more buckets, one after another.
MOST_REDUCERS = 20_000


def reducers(spark: SparkSession, buckets: int) -> int:
    """A task for each bucket, no more than MOST_REDUCERS, and no fewer than the session shuffles to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets, MOST_REDUCERS))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that any bits of the result can choose a bucket."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0x9FB21C651E98DF25)
    h ^= h >> U64(32)
    return h


def unmixed_power(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[:1] = 1
    done = 1
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        have = _POWERS[base] = unmixed_power(base, size), unmixed_power(pow(base, -1, 1 << 64), size)
    return have


def spans(base: int, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of values[lo:hi], each by its content alone, whatever its place."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some consecutive texts: hash, text number, and number of words by text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool):
        b = LOWER[buf] if lower else buf
        ink = ~SPACE[b]
        first = np.zeros(len(b) + 1, bool)
        first[offsets[:-1]] = True
        before = np.concatenate(([False], ink[:-1])) if len(b) else ink
        self.start = np.flatnonzero(ink & (~before | first[:-1]))
        first[offsets] = True
        after = np.concatenate((ink[1:], [False])) if len(b) else ink
        self.end = np.flatnonzero(ink & (~after | first[1:])) + 1
        self.hash = spans(BYTE_BASE, b.astype(U64) + U64(1), self.start, self.end)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(offsets) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))


_FRUGAL = False


def frugal() -> None:
    """In a Python worker: large arrays that are freed go back to the system, not to a pool that the worker keeps until it ends."""
    global _FRUGAL
    if not _FRUGAL:
        _FRUGAL = True
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            ctypes.CDLL(None).mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        except (OSError, AttributeError):  # another C library
            pass


def slices(texts: pa.Array):
    """(first row, bytes, offsets) of runs of rows of about SLICE_BYTES each; null counts as empty. A longer text makes
    a run of its own: texts are never cut."""
    frugal()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(off, off[row] + SLICE_BYTES, side="right")) - 1)
        yield row, data[off[row] : off[to]], off[row : to + 1] - off[row]
        row = to


def runs_of(texts: pa.Array, most: int):
    """(first row, rows) of runs of at most `most` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, side="right")))
        yield row, to - row
        row = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)


def binary(parts) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def unpack(batches, *kinds: tuple[str, type]) -> list[np.ndarray]:
    """Joins the packed columns of all rows of a partition."""
    got: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for out, (name, kind) in zip(got, kinds):
            col = column(batch, name)
            out += [np.frombuffer(x.as_buffer(), kind) for x in col if x.is_valid]
    return [np.concatenate(x) if x else np.zeros(0, kind) for x, (_, kind) in zip(got, kinds)]


def narrow(parts) -> pa.Array:
    """Numbers from 0 on, each part in the least unsigned type that holds it."""
    return binary(x.astype(np.min_scalar_type(x.max(initial=0))) for x in parts)


def widen(batches: list, name: str, beside: str) -> np.ndarray:
    """Joins a narrowed column; the column beside it has as many entries, of 8 bytes each."""
    got = [np.zeros(0, np.int32)]
    for batch in batches:
        for x, y in zip(column(batch, name), column(batch, beside)):
            x, many = x.as_buffer(), y.as_buffer().size // 8
            if many:
                got.append(np.frombuffer(x, f"u{x.size // many}").astype(np.int32))
    return np.concatenate(got)


def bucket_runs(batches):
    """From rows sorted by bucket, the rows of one bucket after another (as lists of batches): a task holds one bucket."""
    frugal()
    now, held = None, []
    for batch in batches:
        b = column(batch, "bucket").to_numpy()
        at = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
        for lo, hi in zip(at[:-1], at[1:]):
            if lo < hi:
                if held and b[lo] != now:
                    yield held
                    held = []
                now = b[lo]
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by bucket, the buckets that have rows, and where each begins (with the end)."""
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    return order, found, np.append(begin, len(bucket))


def crc(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node that can be reached.

    Alternates large-star and small-star steps; each is an aggregation (combined map-side) and an equi-join, so a node
    with very many links needs no group of its own. Each step is written to the shared folder; the driver gets only
    two numbers of each, to see when nothing changes any more."""
    spark = edges.sparkSession

    def state(df: DataFrame):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    was = state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialize(small.distinct())
        then, was = was, state(now)
        if then == was:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, whatever else the table carries."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def running_start(df: DataFrame, group: list[str], value: str, tie: list[str], out: str, each: int = 1_000, fan: int = 1_000) -> DataFrame:
    """Adds out: the sum of value over the rows before this one in its group, and out_chunk, out_row (its place, unique
    in the group). Columns of group hold no null. The order is by a hash chunk of about `each` rows, then by tie. Chunks' totals are summed in two steps (inside each
    `fan` chunks, then over these), so a group with a third of all rows is dealt to as many tasks as any others, and no task
    gets more than rows / (each * fan) totals. Rows equal in all of tie share a chunk."""
    rows = df.count()
    chunks = max(1, -(-rows // each))
    df = df.withColumn(f"{out}_chunk", F.pmod(F.xxhash64(*tie), F.lit(chunks)).cast("int"))
    key = [*group, f"{out}_chunk"]
    inside = Window.partitionBy(*key).orderBy(*tie, value)
    df = df.withColumn(f"{out}_row", F.row_number().over(inside) - 1)
    df = df.withColumn("_in", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    totals = df.groupBy(*key).agg(F.sum(value).alias("_sum")).withColumn("_fan", F.floor(F.col(f"{out}_chunk") / fan))
    before = lambda by, at, what: F.sum(what).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)) - F.col(what)
    fans = totals.groupBy(*group, "_fan").agg(F.sum("_sum").alias("_all"))
    fans = fans.withColumn("_outer", before(group, "_fan", "_all")).drop("_all")
    totals = totals.withColumn("_before", before([*group, "_fan"], f"{out}_chunk", "_sum")).drop("_sum")
    totals = totals.join(fans, [*group, "_fan"]).withColumn("_before", F.col("_before") + F.col("_outer")).drop("_fan", "_outer")
    return df.join(totals, key).withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in")


def bounded_sample(labels: DataFrame, bound: int) -> DataFrame:
    """At most `bound` rows (doc_id, label), the first by a hash of doc_id; for broadcasting."""
    order = F.xxhash64("doc_id", F.lit(7))
    return labels.select("doc_id", "label").filter("doc_id is not null and label is not null").orderBy(order, "doc_id", "label").limit(bound)


def adam(gradient, start: list[np.ndarray], turns: int, rate: float) -> list[np.ndarray]:
    """Minimises by Adam, full batch; gradient(params) gives a list like params. Deterministic."""
    p = [x.astype(np.float64) for x in start]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for t in range(1, turns + 1):
        for i, g in enumerate(gradient(p)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
