"""Exact dedup by distributed MSD radix partitioning.

All texts (white space `[\\x20\\x09-\\x0D]` deleted, as UTF-8) start in one group. Each level splits every group by its next
digit, the successive bytes from where the last level stopped; a text that ends inside the digit is set apart from one that
goes on. A group that is a single row, or whose texts have ended, is settled. Digits widen from level to level
(`FIRST_DIGIT`, then `WIDER` times as many bytes), so a text of any length takes a few levels. Two texts meet only by having
all their bytes equal: no digest takes part in that. (text_sha256 is an output.)

A level is an aggregation, combined before its shuffle, and an equi-join with its own input. Large groups, at most HOT or as
many as HOT_BYTES of digits hold, are broadcast, and their rows are dealt by row: a group of copies with a third of all rows
meets no single task. Only rows that are still undecided are read again, from the shared folder.

Null text counts as empty, so null and white-space texts are one group. A null doc_id takes part; the smallest
doc_id is the smallest that is not null. Of rows that agree in text length and doc_id, one stays. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

FIRST_DIGIT, WIDER = 64, 16
#: A group is large from 1/HOT of the rows on, so there are HOT at most; with wide digits, fewer.
HOT, HOT_BYTES = 1000, 1 << 24


def _joined(digit: DataFrame, group: DataFrame, key: list[str], rows: int, width: int) -> DataFrame:
    """digit with the columns group_size and best of its group."""
    most = max(1, min(HOT, HOT_BYTES // width))
    hot = group.filter(F.col("group_size") * most >= max(rows, 20 * most)).select(*key, F.col("group_size").alias("hot_size"), F.col("best").alias("hot_best"))
    spread = digit.join(F.broadcast(hot), key, "left").withColumn("dealt", F.when(F.col("hot_size").isNull(), -1).otherwise(F.col("row_id")))
    cold = group.withColumn("dealt", F.lit(-1).cast("long"))
    out = spread.join(cold.hint("shuffle_hash"), [*key, "dealt"], "left")
    return out.withColumn("group_size", F.coalesce("hot_size", "group_size")).withColumn("best", F.coalesce("hot_best", "best"))


def exact_groups(docs: DataFrame, **how) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, and row_id (of the row in docs)."""
    return _groups(pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"), **how)


def _groups(numbered: DataFrame, first_digit: int = FIRST_DIGIT, wider: int = WIDER) -> DataFrame:
    live = numbered.select(
        "row_id",
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("chars"),
        F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary").alias("bytes"),
    ).withColumn("text_sha256", F.sha2("bytes", 256)).withColumn("prefix", F.lit(0).cast("long"))
    done, at, width, rows = None, 0, first_digit, numbered.count()
    while True:
        digit = live.withColumn("digit", F.substring("bytes", at + 1, width)).withColumn("ended", F.octet_length("bytes") <= at + width)
        key = ["prefix", "digit", "ended"]
        # the longest original first, then the smallest doc_id (nulls after all), then the first row
        rank = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_id")
        group = digit.groupBy(*key).agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
        open_ = "group_size > 1 and not ended"
        level = _joined(digit, group, key, rows, width).select(
            "row_id", "doc_id", "chars", "text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"),
            F.col("best.row_id").alias("prefix"), F.when(F.expr(open_), F.col("bytes")).alias("bytes"),
        )
        level = materialize(level)
        settled = level.filter("bytes is null").select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "row_id")
        done = settled if done is None else done.unionByName(settled)
        live = level.filter("bytes is not null").select("row_id", "doc_id", "chars", "bytes", "text_sha256", "prefix")
        rows = live.count()
        if not rows:
            return done
        at, width = at + width, width * wider


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns, whatever their names: rows are written with a number once, and both the
    groups and the choice read that table."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct("*").alias("doc")))
    stays = _groups(numbered.select("row_id", "doc.doc_id", "doc.text")).filter("kept").select("row_id")
    return numbered.join(stays, "row_id", "left_semi").select("doc.*")
