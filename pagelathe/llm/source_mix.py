"""Mixing sources to target weights.

The words of a source's documents, one document after another, are packed into blocks of a fixed number of words (the last may
be short). The mix is a row of slots, one block each, dealt over output shards. Each shard draws how many of its slots each
source gets from a multinomial whose weights are the blocks that the sources still have to give; so every source ends at its
target, and no shard is far from it. A source's k-th slot maps to a block by a keyed pseudorandom permutation of the source's
block indices (a Feistel network; a permutation of its own for each pass), so a block is used at most once a pass, and no
document more than `most` times. Slots and blocks then join by (source, block index).

The driver holds the sources' totals and the shards' counts (at most MAX_SHARDS by the number of sources), never documents.
All draws are keyed by the seed and by stable ids: reruns agree.

Words are taken in blocks (`block_words`, 64 by default), so a source ends within one block of its target, times 2 where
its last block is short: exact enough for any source of some hundred words, coarse for smaller ones. MAX_SHARDS only bounds the
number of output shards; larger mixes have larger shards.

Null text has no words and is never drawn. A null source is a source of its own and comes last. Rows that share a doc_id
are separate documents. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, column, materialize, mix, pick, running_start

WORD = r"[^\x20\x09-\x0D]+"
MAX_SHARDS = 4096


def fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Shares of share * sum(sizes) by weight; none above most * its size, what is over is shared again by weight."""
    left, out, free = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] >= most * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            free.remove(i)
    return out


def draw(quota: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): multinomial counts of each shard by what is left of each quota; columns sum to the quotas."""
    rng, left, total = np.random.default_rng(seed), np.array(quota, np.int64), int(sum(quota))
    out = np.zeros((shards, len(quota)), np.int64)
    for s in range(shards):
        want = total * (s + 1) // shards - total * s // shards
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[s] += got
            left -= got
            want -= int(got.sum())
    return out


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size), by a four-round Feistel network that walks back into the range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = U64((1 << half) - 1)

    def network(x):
        a, b = x >> U64(half), x & low
        for turn in range(4):
            a, b = b, a ^ (mix(b ^ U64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % (1 << 64))) & low)
        return (a << U64(half)) | b

    out = network(index.astype(U64))
    while len(far := np.flatnonzero(out >= size)):
        out[far] = network(out[far])
    return out.astype(np.int64)


def _slots(seed, step=1 << 18):
    def run(batches):
        for batch in batches:
            for shard, source, blocks, begin, count in zip(*(column(batch, n).to_pylist() for n in ("shard", "source_no", "blocks", "begin", "count"))):
                for lo in range(begin, begin + count, step):
                    k = np.arange(lo, min(lo + step, begin + count))
                    block = np.empty(len(k), np.int64)
                    for turn in np.unique(k // blocks):
                        at = k // blocks == turn
                        block[at] = permuted(k[at] % blocks, blocks, seed * 1_000_003 + source * 8191 + int(turn))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard)), pa.array(np.full(len(k), source)), pa.array(k), pa.array(block)], names=["shard", "source_no", "slot", "block"])

    return run


def plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, block_words: int = 64, seed: int = 1, shard_slots: int = 65_536, keep: tuple = ()):
    """(sized, pieces, slots). sized: the documents' rows with size, source_size, target and their place (and the columns keep); pieces: which
    words of which document each block has; slots: which block each slot of each shard takes."""
    spark = docs.sparkSession
    sized = pick(docs, "doc_id", "source", "text", *keep).select(*keep, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialize(sized)
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["size"] for r in found]
    targets = fill(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], share, most)
    blocks = [-(-s // block_words) for s in sizes]
    quota = [min(most * b, round(t * b / s)) if s else 0 for t, b, s in zip(targets, blocks, sizes)]
    rows = [(i, r["source"], int(s), float(t)) for i, (r, s, t) in enumerate(zip(found, sizes, targets))]
    totals = spark.createDataFrame(rows, "source_no long, name string, source_size long, target double")
    sized = sized.join(totals, sized["source"].eqNullSafe(totals["name"])).drop("name")
    sized = materialize(running_start(sized, ["source_no"], "size", ["doc_id", "size"], "place"))
    w = F.lit(block_words)
    pieces = sized.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(place div {block_words}, (place + size - 1) div {block_words})")))
    pieces = pieces.withColumn("skip", F.greatest(F.lit(0).cast("long"), F.col("block") * w - F.col("place"))).withColumn("words", F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * w) - F.col("place") - F.col("skip"))

    total = sum(quota)
    shards = max(1, min(MAX_SHARDS, -(-total // shard_slots)))
    drawn = draw(quota, shards, seed) if total else np.zeros((0, len(quota)), np.int64)
    begin = np.cumsum(drawn, axis=0) - drawn
    rows = [(int(s), int(i), int(blocks[i]), int(begin[s, i]), int(drawn[s, i])) for s, i in zip(*np.nonzero(drawn))]
    shard_plan = spark.createDataFrame(rows, "shard long, source_no long, blocks long, begin long, count long")
    slots = shard_plan.repartition(max(1, min(len(rows), shards)), "shard").mapInArrow(_slots(seed), "shard long, source_no long, slot long, block long")
    return sized, pieces, slots


PLACE = ["source_no", "place", "place_chunk", "place_row"]


def used(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """The pieces of the blocks that the mix takes, with how many slots take them."""
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    return pieces.join(times, ["source_no", "block"])


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target (of its source), taken."""
    sized, pieces, slots = plan(docs, **how)
    taken = used(pieces, slots).groupBy(*PLACE).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return sized.join(taken, PLACE, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _plan_by_row(docs: DataFrame, **how):
    """(numbered, pieces, slots): docs written as (row_id, doc), and the plan whose pieces have the row_id."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("doc")))
    _, pieces, slots = plan(numbered.select("row_id", "doc.doc_id", "doc.source", "doc.text"), keep=("row_id",), **how)
    return numbered, pieces, slots


def mixed_blocks(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: one row for each piece of each slot (shard, source_no, slot, piece, doc_id, text)."""
    numbered, pieces, slots = _plan_by_row(docs, **how)
    cut = pieces.join(numbered.select("row_id", F.col("doc.text").alias("text")), "row_id")
    cut = cut.withColumn("text", F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("skip") + 1).cast("int"), F.col("words").cast("int")), " "))
    cut = cut.withColumn("piece", F.row_number().over(Window.partitionBy("source_no", "block").orderBy("place", "place_row")))
    return slots.join(cut.select("source_no", "block", "piece", "doc_id", "text"), ["source_no", "block"])


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs after the mix: a document's text is the words of it that the mix takes, repeats included, in its order; one of
    which nothing is taken goes. Rows go by their own runs, whatever their doc_id, with all columns, whatever their names;
    n_chars, where there is such a column, follows."""
    numbered, pieces, slots = _plan_by_row(docs, **how)
    runs = used(pieces, slots).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(*(F.col(n).cast("int").alias(n) for n in ("skip", "words", "times"))))).alias("runs"))
    # The words are bound by the outer lambda, so that a text is parted once and not once a run.
    each = "repeat(concat(array_join(slice(w, r.skip + 1, r.words), ' '), ' '), r.times)"
    text = F.expr(f"rtrim(' ', element_at(transform(array(regexp_extract_all(doc.text, r'{WORD}', 0)), w -> array_join(transform(runs, r -> {each}), '')), 1))")
    doc = F.col("doc").withField("text", text)
    out = numbered.join(runs, "row_id").select(doc.alias("doc"))
    if "n_chars" in docs.columns:
        out = out.select(F.col("doc").withField("n_chars", F.length("doc.text").cast(docs.schema["n_chars"].dataType)).alias("doc"))
    return out.select("doc.*")
