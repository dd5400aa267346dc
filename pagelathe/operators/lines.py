"""From spans to lines to blocks: running lines, paragraph grouping, kinds, sections, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LIST_HEAD, japanese_chars, strip
from ..params import Params

PAGE = ["doc_id", "page_no"]
#: So many spans of a line are joined at a time.
JOINED = 256


def collect_lines(spans: DataFrame) -> DataFrame:
    """One row a line: text of its spans in order, box of the first, representative size and boldness; blank lines go. Spans are shuffled
    and sorted once, by page, and all windows follow that order. A window hands its list to each row of the line, so texts are joined
    by JOINED spans, then these pieces."""
    bold = (F.col("flags").bitwiseAND(16) != 0) | F.lower("font").contains("bold")
    out = spans.withColumn("_bold", F.coalesce(bold, F.lit(False))).drop("flags", "font").repartition(*PAGE)
    n, japanese = F.col("_n"), F.col("_japanese")
    out = out.withColumn("_n", F.length(strip(F.col("text")))).withColumn("_japanese", japanese_chars(F.col("text")))
    rank = F.when(n > 0, F.struct(japanese > 0, F.when(japanese > 0, japanese).otherwise(n), -F.col("span_ord")))  # blank spans don't count
    page = PAGE[::-1]  # page numbers differ most, so they are compared first
    line = Window.partitionBy(*page, "block_ord", "line_ord").orderBy("span_ord", "text")
    whole, piece = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), line.rowsBetween(0, JOINED - 1)
    box, join = ("x0", "y0", "x1", "y1"), lambda texts, w: F.array_join(F.collect_list(texts).over(w), "")
    out = out.select(
        *PAGE, "block_ord", "line_ord", "span_ord", "text", *box, (F.row_number().over(line) - 1).alias("_k"), join("text", piece).alias("_piece"),
        F.max_by(F.bround("size", 1), rank).over(whole).alias("size"), F.sum(F.when(F.col("_bold"), n).otherwise(0)).over(whole).alias("_heavy"), F.sum(n).over(whole).alias("_all"),
    ).filter((F.col("_k") % JOINED == 0) & (F.col("_all") > 0))
    bold = F.try_divide("_heavy", "_all") >= 0.8
    out = out.select(*PAGE, "block_ord", "line_ord", "_k", join("_piece", whole).alias("text"), *box, "size", bold.alias("bold")).filter("_k = 0").drop("_k")
    return out.withColumn("ord", F.row_number().over(Window.partitionBy(*page).orderBy("block_ord", "line_ord")) - 1)


def size_histogram(lines: DataFrame, size="size", text="text") -> DataFrame:
    """Characters by size, with their share of the document; first_ord breaks ties by first appearance."""
    n = lines.groupBy("doc_id", F.bround(size, 1).alias("size")).agg(F.sum(F.length(strip(F.col(text)))).alias("chars"), F.min(F.struct("page_no", "ord")).alias("first_ord"))
    return n.withColumn("share", F.bround(F.col("chars") * 100.0 / F.sum("chars").over(Window.partitionBy("doc_id")), 1))


def body_size(histogram: DataFrame) -> DataFrame:
    best = Window.partitionBy("doc_id").orderBy(F.desc("chars"), "first_ord")
    return histogram.withColumn("n", F.row_number().over(best)).filter("n = 1").select("doc_id", F.coalesce("size", F.lit(0.0)).alias("body"))


def running_lines(lines: DataFrame, p: Params, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, bucket) of lines that recur on enough pages at one left edge. pages: doc_id, n_pages of the documents, blank pages
    too; without it the last page with a line is taken to be the last."""
    if pages is None:
        pages = lines.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))
    pages = pages.select("doc_id", F.col("n_pages").alias("all_pages"))
    seen = lines.groupBy("doc_id", strip(F.col("text")).alias("text"), F.bround(F.col("x0") / 3).alias("bucket")).agg(F.countDistinct("page_no").alias("pages"))
    least = F.greatest(F.lit(p.min_repeat_pages), F.floor(F.col("all_pages") * p.repeat_ratio + 0.999))
    found = seen.join(pages, "doc_id").filter(F.col("pages") >= least)
    return found.select("doc_id", "text", "bucket", "pages") if p.repeat_ratio else found.limit(0).select("doc_id", "text", "bucket", "pages")


def without_running(lines: DataFrame, running: DataFrame) -> DataFrame:
    keys = running.select("doc_id", F.col("text").alias("_text"), F.col("bucket").alias("_bucket"))
    on = (lines["doc_id"] == keys["doc_id"]) & (strip(lines["text"]) == F.col("_text")) & (F.bround(lines["x0"] / 3) == F.col("_bucket"))
    return lines.join(keys, on, "left_anti")


def group_lines(lines: DataFrame, p: Params) -> DataFrame:
    """Numbers the blocks of a page: a line goes on with the line just before it if size, left edge and leading fit, it is no
    list head, and boldness stays. Null boldness counts as plain."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    before = lambda c: F.lag(c).over(w)
    fits = (F.abs(F.col("size") - before("size")) <= p.size_tol + 0.05) & (F.abs(F.col("x0") - before("x0")) <= p.col_tol) & (F.col("y0") - before("y0")).between(F.lit(0.0), before("size") * p.line_gap)
    fits = fits & ~F.regexp_replace("text", r"(?U)^[\s\x1C-\x1F]+", "").rlike(LIST_HEAD) & (F.coalesce("bold", F.lit(False)) == F.coalesce(before("bold"), F.lit(False)))
    return lines.withColumn("_new", F.when(fits, 0).otherwise(1)).withColumn("block", F.sum("_new").over(w) - 1).drop("_new")


def kind(size, body, p: Params):
    """tiny is tested first, then body, then large or small."""
    return F.when((body * p.tiny_ratio > 0) & (size < body * p.tiny_ratio), "tiny").when(F.abs(size - body) <= p.size_tol, "body").when(size > body, "large").otherwise("small")


def is_section(kind_, size, raw, body, p: Params, forced=None):
    least = F.lit(p.section_min_pt) if p.section_min_pt is not None else body + 3.0
    return (kind_ == "large") & ((size >= least) if forced is None else forced | (size >= least)) & F.length(strip(raw)).between(1, p.section_max_len)


def carry_sections(blocks: DataFrame, order: list[str]) -> DataFrame:
    """section: the latest heading so far, over pages; number: of the block in its document. order begins with page_no. Each page is a
    group of its own; from page to page go only its last heading and its number of blocks."""
    inner = order[1:]
    rows = blocks.withColumn("_heading", F.when(F.col("is_section"), strip(F.col("raw"))))
    last = F.max_by("_heading", F.when(F.col("_heading").isNotNull(), F.struct(*inner)))
    pages = rows.groupBy(*PAGE).agg(last.alias("_last"), F.count("*").alias("_many"))
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.select(*PAGE, F.last("_last", True).over(before).alias("_carried"), F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy(*PAGE).orderBy(*inner)
    rows = rows.join(pages, PAGE).withColumn("section", F.coalesce(F.last("_heading", True).over(w), "_carried", F.lit("")))
    return rows.withColumn("number", F.row_number().over(w) + F.col("_start")).drop("_heading", "_carried", "_start")


def number_in_document(rows: DataFrame, inner: list[str], name: str) -> DataFrame:
    """Adds name: the row's number in its document, from 0, by page_no and then inner: counted page by page, then over the pages' counts."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy(*PAGE).agg(F.count("*").alias("_n")).select(*PAGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*PAGE).orderBy(*inner)) - 1
    return rows.join(start, PAGE).withColumn(name, inside + F.col("_start")).drop("_start")


def reading_order(blocks: DataFrame, p: Params, width: float | DataFrame) -> DataFrame:
    """rank: by column, then top edge, then left edge. Columns part where left edges leave a gap of col_gap_ratio of the page's width.
    width: of all pages, or a table doc_id, page_no, width."""
    edges = blocks.select(*PAGE, "x0").distinct()
    after = F.lead("x0").over(Window.partitionBy(*PAGE).orderBy("x0"))
    edges = edges.withColumn("_next", after)
    edges = edges.join(width.select(*PAGE, F.col("width").alias("_width")), PAGE) if isinstance(width, DataFrame) else edges.withColumn("_width", F.lit(float(width)))
    cuts = edges.filter(F.col("_next") - F.col("x0") >= F.col("_width") * p.col_gap_ratio)
    cuts = cuts.groupBy(*PAGE).agg(F.collect_list((F.col("x0") + F.col("_next")) / 2).alias("_cuts"))
    column = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("x0"))), F.lit(0))
    out = blocks.join(cuts, PAGE, "left").withColumn("column", F.when(F.col("_cuts").isNull(), 0).otherwise(column)).drop("_cuts")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("column", "y0", "x0", "ord")))
