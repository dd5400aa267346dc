"""Rectangles: tables, cells, nesting, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import band, strip


def overlap_ratio(a, b):
    """Common area over the smaller area; 0 where that is empty. a and b: structs with x0, y0, x1, y1, or prefixes of columns."""
    c = lambda p, n: F.col(f"{p}{n}") if isinstance(p, str) else p[n]
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(c(a, hi), c(b, hi)) - F.greatest(c(a, lo), c(b, lo)))
    area = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "y1") - c(p, "y0"))
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, side("x0", "x1") * side("y0", "y1") / smaller).otherwise(0.0)


def outermost(tables: DataFrame, tol: float = 1.0) -> DataFrame:
    """Tables of a page without those that strictly hold another: of nested frames the inner ones stay."""
    inner = tables.select("doc_id", "page_no", *(F.col(c).alias(f"i_{c}") for c in ("table_no", "x0", "y0", "x1", "y1")))
    holds = (F.col("x0") <= F.col("i_x0") + tol) & (F.col("y0") <= F.col("i_y0") + tol) & (F.col("x1") >= F.col("i_x1") - tol) & (F.col("y1") >= F.col("i_y1") - tol)
    larger = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > (F.col("i_x1") - F.col("i_x0")) * (F.col("i_y1") - F.col("i_y0"))
    on = (tables["doc_id"] == inner["doc_id"]) & (tables["page_no"] == inner["page_no"]) & (F.col("table_no") != F.col("i_table_no")) & holds & larger
    return tables.join(inner, on, "left_anti")


def lines_in_tables(lines: DataFrame, tables: DataFrame, pad: float = 2.0) -> DataFrame:
    """Lines with the first table of their page that holds their centre (cx, cy), and the row and column band there."""
    t = tables.select("doc_id", "page_no", "table_no", "xbounds", "ybounds", *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    inside = F.col("cx").between(F.col("t_x0") - pad, F.col("t_x1") + pad) & F.col("cy").between(F.col("t_y0") - pad, F.col("t_y1") + pad)
    met = lines.join(t, ["doc_id", "page_no"]).filter(inside)
    first = met.groupBy("doc_id", "page_no", "ord").agg(F.min_by(F.struct("table_no", "xbounds", "ybounds", "cx", "cy"), "table_no").alias("t"))
    return first.select("doc_id", "page_no", "ord", "t.table_no", band(F.col("t.ybounds"), F.col("t.cy")).alias("row"), band(F.col("t.xbounds"), F.col("t.cx")).alias("col"))


def duplicate_pairs(blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of blocks of a page with the same text (white space aside) that overlap by `least`."""
    key = F.regexp_replace("raw", r"(?U)\s+", "")
    box = ("ord", "x0", "y0", "x1", "y1")
    a = blocks.withColumn("key", key).filter("key <> ''").select("doc_id", "page_no", "key", *(F.col(c).alias(f"a_{c}") for c in box))
    b = blocks.withColumn("key", key).select("doc_id", "page_no", "key", *(F.col(c).alias(f"b_{c}") for c in box))
    return a.join(b, ["doc_id", "page_no", "key"]).filter("a_ord < b_ord").withColumn("ratio", overlap_ratio("a_", "b_")).filter(F.col("ratio") >= least)


def bounds(cells, lo: int, hi: int):
    """Sorted distinct edges of the cells along an axis, to a tenth of a point."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(cells, lambda c: F.array(F.bround(c[lo], 1), F.bround(c[hi], 1))))))


def usable(tables: DataFrame) -> DataFrame:
    """Tables (x0, y0, x1, y1, cells) with their bounds, at least two rows and two columns; the rest go."""
    out = tables.withColumn("xbounds", bounds(F.col("cells"), 0, 2)).withColumn("ybounds", bounds(F.col("cells"), 1, 3))
    return out.filter((F.size("xbounds") >= 3) & (F.size("ybounds") >= 3))


def detected(strict: DataFrame, fallback: DataFrame, manual: DataFrame, off: DataFrame) -> DataFrame:
    """The tables of a page: found by the strict strategy, by the fallback only where that found none, neither on pages switched off; those
    drawn by hand always. Nested frames go, and the rest are numbered, drawn ones last."""
    page = ["doc_id", "page_no"]
    auto = usable(strict).withColumn("manual", F.lit(False))
    auto = auto.unionByName(usable(fallback).join(auto.select(*page).distinct(), page, "left_anti").withColumn("manual", F.lit(False))).join(off, page, "left_anti")
    every = auto.unionByName(usable(manual).withColumn("manual", F.lit(True)))
    number = F.row_number().over(Window.partitionBy(*page).orderBy("manual", "table_no")) - 1
    return outermost(every.withColumn("table_no", number))


def table_rows(lines: DataFrame, tables: DataFrame, pad: float = 2.0) -> DataFrame:
    """One row a table row: lines (with their column) and raw. A line belongs to the first table that holds its centre and there to
    the first cell that does. A cell of one row band is of that band; one over several is of its first band, unless leaps of over
    1.8 sizes part it into runs, each then in the band of its first line. Lines in no cell go by their centre. Lines of one
    column, height and left edge keep their order."""
    page = ["doc_id", "page_no"]
    t = tables.select(*page, "table_no", "xbounds", "ybounds", "cells", *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = F.col("cx").between(F.col("t_x0") - pad, F.col("t_x1") + pad) & F.col("cy").between(F.col("t_y0") - pad, F.col("t_y1") + pad)
    met = lines.withColumn("cx", cx).withColumn("cy", cy).join(t, page).filter(inside)
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy(*page, "ord").orderBy("table_no"))).filter("_n = 1")
    holds = F.transform("cells", lambda c: F.col("cx").between(c[0] - 0.5, c[2] + 0.5) & F.col("cy").between(c[1] - 0.5, c[3] + 0.5))
    out = first.withColumn("cell_no", F.array_position(holds, F.lit(True)).cast("int")).withColumn("cell", F.try_element_at("cells", F.nullif("cell_no", F.lit(0))))
    out = out.withColumn("col", band(F.col("xbounds"), F.coalesce((F.col("cell")[0] + F.col("cell")[2]) / 2, "cx")))
    out = out.withColumn("_top", band(F.col("ybounds"), F.col("cell")[1] + 0.5)).withColumn("_end", band(F.col("ybounds"), F.col("cell")[3] - 0.5))
    cell = Window.partitionBy(*page, "table_no", "cell_no")
    down = cell.orderBy("y0", "x0", "ord")
    leap = F.col("y0") - F.lag("y0").over(down) > F.greatest("size", F.lag("size").over(down)) * 1.8
    out = out.withColumn("_run", F.when(leap, 1).otherwise(0)).withColumn("_run", F.sum("_run").over(down)).withColumn("_runs", F.max("_run").over(cell))
    at_run = F.first("cy").over(Window.partitionBy(*page, "table_no", "cell_no", "_run").orderBy("y0", "x0", "ord"))
    out = out.withColumn("_at", at_run)
    row = F.when(F.col("cell_no") == 0, band(F.col("ybounds"), F.col("cy"))).when((F.col("_end") <= F.col("_top")) | (F.col("_runs") == 0), F.col("_top")).otherwise(band(F.col("ybounds"), F.col("_at")))
    place = F.struct("col", F.bround(F.col("cy") / F.greatest("size", F.lit(1.0)) / 0.8).alias("k"), "x0", "ord", "y0", "x1", "y1", "size", "text")
    rows = out.withColumn("row", row).groupBy(*page, "table_no", "row").agg(F.array_sort(F.collect_list(place)).alias("lines"), F.max("size").alias("size"), F.min("t_x0").alias("x0"), F.min("y0").alias("y0"), F.max("t_x1").alias("x1"), F.max("y1").alias("y1"))
    texts = F.transform(F.array_distinct(F.transform("lines", lambda n: n["col"])), lambda c: F.array_join(F.transform(F.filter("lines", lambda n: n["col"] == c), lambda n: strip(n["text"])), ""))
    return rows.withColumn("raw", F.array_join(F.filter(texts, lambda x: x != ""), " "))


def outside_tables(lines: DataFrame, rows: DataFrame) -> DataFrame:
    inside = rows.select("doc_id", "page_no", F.explode("lines.ord").alias("ord"))
    return lines.join(inside, ["doc_id", "page_no", "ord"], "left_anti")
