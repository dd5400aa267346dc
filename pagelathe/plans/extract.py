"""From lines and tables to sentences, with recorded corrections, over all pages of all documents at once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import units
from ..operators import folds, lines as L, rules as R, tables as T
from ..params import Params

PAGE = ["doc_id", "page_no"]
LINE = ("ord", "text", "x0", "y0", "x1", "y1", "size")


def cut(rows: DataFrame, *spent: DataFrame) -> DataFrame:
    """Rows written once to the folder that spark.checkpoint.dir names, and read from there. Each step below reads its input two or three
    times; without cuts the reads multiply from step to step. spent: cut tables that rows is the last to read, deleted once it is
    written, and with them what was shuffled to write it. The table goes when the driver's file system closes at the latest."""
    spark = rows.sparkSession
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = context.getCheckpointDir() or tempfile.mkdtemp(prefix="pagelathe-")
        context.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    system.deleteOnExit(place)
    for old in spent:
        system.delete(context._jvm.org.apache.hadoop.fs.Path(old._cut), True)
    if spent:
        context._jvm.System.gc()  # Spark's cleaner deletes shuffles that nothing refers to
    out = spark.read.schema(rows.schema).parquet(path)
    out._cut = path
    return out


def _blocks(lines: DataFrame, p: Params) -> DataFrame:
    """Groups of lines as blocks: raw, size (the commonest, the first on ties), box, lines."""
    every = F.array_sort(F.collect_list(F.struct(*LINE)))
    out = L.group_lines(lines, p).groupBy(*PAGE, "block").agg(every.alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    sizes = F.transform("lines", lambda n: n["size"])
    counts = F.transform(F.array_distinct(sizes), lambda v, i: F.struct(F.size(F.filter(sizes, lambda x: x.eqNullSafe(v))).alias("n"), (-i).alias("i"), v.alias("size")))
    return out.withColumn("size", F.array_max(counts)["size"]).withColumn("raw", F.array_join(F.transform("lines", lambda n: n["text"]), "")).withColumn("table_no", F.lit(None).cast("int")).withColumnRenamed("block", "ord")


def _renumber(blocks: DataFrame, *order) -> DataFrame:
    return blocks.withColumn("ord", (F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)) - 1).cast("int"))


def _fuse(blocks: DataFrame) -> DataFrame:
    """Blocks that join_blocks put in one group become one, at the place of the first."""
    first = F.coalesce(F.first("ord", True).over(Window.partitionBy(*PAGE, "hidden", "group").orderBy("ord")), F.col("ord"))
    key = F.when(F.col("hidden"), F.col("ord")).otherwise(first)
    parts = F.array_sort(F.collect_list(F.struct("ord", "raw", "lines")))
    kept = [c for c in blocks.columns if c not in (*PAGE, "ord", "raw", "lines", "group", "x0", "y0", "x1", "y1")]
    out = blocks.withColumn("_key", key).groupBy(*PAGE, "_key").agg(parts.alias("_p"), *(F.min_by(c, "ord").alias(c) for c in kept), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    raws = F.transform("_p", lambda x: x["raw"])
    return out.withColumn("raw", F.array_join(raws, "")).withColumn("parts", raws).withColumn("lines", F.flatten(F.transform("_p", lambda x: x["lines"]))).withColumnRenamed("_key", "ord").drop("_p")


def _marked(blocks: DataFrame, excluded: DataFrame | None, p: Params) -> DataFrame:
    """units: struct(text, excluded) of each block; hidden: it has units and a rule meets each."""
    out = blocks.withColumn("_u", units(F.col("raw"), p.terminator, p.min_len))
    if excluded is None:
        return out.withColumn("units", F.transform("_u", lambda t: F.struct(t.alias("text"), F.lit(False).alias("excluded")))).withColumn("hidden", F.lit(False)).drop("_u")
    rows = blocks.select(*PAGE, "ord", "size", "x0", "y0", F.explode(units(F.col("raw"), p.terminator, p.min_len)).alias("text"))
    gone = R.excluded(rows, excluded).groupBy(*PAGE, "ord").agg(F.collect_set("text").alias("_gone"))
    out = out.join(gone, [*PAGE, "ord"], "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<string>")))
    out = out.withColumn("units", F.transform("_u", lambda t: F.struct(t.alias("text"), F.array_contains("_gone", t).alias("excluded"))))
    out = out.withColumn("hidden", (F.size("units") > 0) & F.forall("units", lambda u: u["excluded"]))
    return out.drop("_u", "_gone")


def blocks(lines: DataFrame, body: DataFrame, p: Params, width: float | DataFrame, tables: DataFrame | None = None, rules: dict[str, DataFrame] | None = None, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Blocks of every page in their final order, with units. lines: of collect_lines, running ones gone; body: doc_id, body; rules: rule
    tables by operation (excluded, joins, splits, kinds, manual_order), absent ones empty; spent: cut tables that only lines reads."""
    rules = rules or {}
    lines = merged = cut(folds.merge_fragments(lines, p.join_gap), *spent)
    found = None
    if tables is not None and p.table_strategy != "none":
        made = T.table_rows(lines, tables)
        lines = T.outside_tables(lines, made)
        found = made.withColumn("ord", (F.row_number().over(Window.partitionBy(*PAGE).orderBy("table_no", "row")) - 1).cast("int"))
    text = _blocks(lines, p)
    if "splits" in rules:
        text = folds.split_blocks(text, rules["splits"])
        found = folds.split_blocks(found, rules["splits"], table=True) if found is not None else None
    order = lambda b: b.withColumn("part", F.lit(0)) if "part" not in b.columns else b
    columns = [*PAGE, "ord", "part", "raw", "lines", "size", "x0", "y0", "x1", "y1", "table_no", "_late"]
    every = order(text).withColumn("_late", F.lit(0)).select(*columns)
    if found is not None:
        same = F.transform("lines", lambda n: F.struct(*(n[c].alias(c) for c in LINE)))
        every = every.unionByName(order(found).withColumn("lines", same).withColumn("_late", F.lit(1)).select(*columns))
    every = _renumber(every, "_late", "ord", "part").drop("_late", "part").join(body, "doc_id", "left").fillna(0.0, ["body"])
    kind = F.when(F.col("table_no").isNotNull(), "table").otherwise(L.kind(F.col("size"), F.col("body"), p))
    every = every.withColumn("kind", kind)
    if "kinds" in rules:
        every = R.override_kinds(every, rules["kinds"], [*PAGE, "ord"], "forced").withColumn("forced", F.coalesce(F.col("forced") == "large", F.lit(False)))
    else:
        every = every.withColumn("forced", F.lit(False))
    whole = cut(every, merged)
    every = last = cut(folds.drop_duplicates(_marked(whole, rules.get("excluded"), p).drop("units")), whole)
    if p.order != "pdf":
        every = _renumber(L.reading_order(every, p, width), "rank").drop("rank", "column")
    if "manual_order" in rules:
        every = _renumber(R.manual_order(every, rules["manual_order"].withColumnRenamed("page", "page_no")), "position").drop("position")
    if "joins" in rules:
        every = _fuse(R.join_blocks(every, rules["joins"])).drop("group")
    else:
        every = every.withColumn("parts", F.array("raw"))
    if p.auto_join:
        last = cut(every, last)
        every = folds.auto_join(last)
    else:
        every = every.withColumn("joined", F.lit(0))
    box = lambda f, c: F.expr(f"array_{f}(transform(lines, n -> n.{c}))")
    grown = F.col("joined") > 0
    for f, c in (("min", "x0"), ("min", "y0"), ("max", "x1"), ("max", "y1")):
        every = every.withColumn(c, F.when(grown, box(f, c)).otherwise(F.col(c)))
    last = cut(every, last)
    out = cut(_marked(_renumber(last, "ord").drop("hidden"), rules.get("excluded"), p), last)
    return out.withColumn("is_section", L.is_section(F.col("kind"), F.col("size"), F.col("raw"), F.col("body"), p, F.col("forced")))


def sentences(every: DataFrame, labels: DataFrame | None = None, p: Params | None = None) -> DataFrame:
    """Sentences left of the blocks, in order: doc_id, ord, page_no, page_label, section, kind, pt, sentence, block_id, cross_page. A sentence that goes
    on at the head of the next page is whole on the first. labels: doc_id, page_no, page_label."""
    p = p or Params()
    carried = L.carry_sections(every, ["page_no", "ord"])
    rows = carried.select(*PAGE, F.col("ord").alias("b"), "section", "kind", F.col("size").alias("pt"), F.col("number").alias("block_id"), F.size("units").alias("_n"), F.posexplode("units").alias("k", "u")).filter("not u.excluded").select("*", F.col("u.text").alias("sentence")).drop("u")
    if p.auto_join:
        pairs = folds.cross_pages(every)
        gone = pairs.select(*PAGE, F.col("head_ord").alias("b"), F.lit(0).alias("k"))
        start = rows.join(gone, [*PAGE, "b", "k"], "left_semi").select(*PAGE, F.col("sentence").alias("_more"))
        to = pairs.join(start, PAGE).select("doc_id", F.col("tail_page").alias("page_no"), F.col("tail_ord").alias("b"), "_more").withColumn("_last", F.lit(True))
        rows = rows.join(gone, [*PAGE, "b", "k"], "left_anti").withColumn("_last", F.col("k") == F.col("_n") - 1).join(to, [*PAGE, "b", "_last"], "left")
        rows = rows.withColumn("cross_page", F.col("_more").isNotNull()).withColumn("sentence", F.when(F.col("_more").isNotNull(), F.concat(F.rtrim("sentence", F.lit(p.terminator)), "_more")).otherwise(F.col("sentence")))
    else:
        rows = rows.withColumn("cross_page", F.lit(False))
    rows = L.number_in_document(cut(rows), ["b", "k"], "ord")
    rows = rows.join(labels, PAGE, "left") if labels is not None else rows.withColumn("page_label", F.lit(None).cast("string"))
    return rows.select("doc_id", "ord", "page_no", F.coalesce("page_label", F.col("page_no").cast("string")).alias("page_label"), "section", "kind", "pt", "sentence", "block_id", "cross_page")


def extract(spans: DataFrame, p: Params | None = None, width: float | DataFrame = 595.0, tables: DataFrame | None = None, rules: dict[str, DataFrame] | None = None, labels: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Sentences of documents from their spans; the body size is estimated unless the parameters give one. width: of all
    pages, or doc_id, page_no, width; pages: doc_id, n_pages, where trailing pages may be blank."""
    p = p or Params()
    lines = cut(L.collect_lines(spans))
    body = cut(L.body_size(L.size_histogram(lines)) if not p.body_size else lines.select("doc_id").distinct().withColumn("body", F.lit(p.body_size)))
    lines = cut(L.without_running(lines, L.running_lines(lines, p, pages)), lines)
    return sentences(blocks(lines, body, p, width, tables, rules, (lines,)), labels, p)

