"""Recorded corrections as joins with rule tables. Null in a rule means any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..params import KINDS

#: Left and top edge may differ by this much (points), sizes by PT_TOL.
AT_TOL, PT_TOL = 1.0, 0.05


def _told(rules: DataFrame, exact: bool) -> DataFrame:
    """Rules with _key, the text they are compared by; blank rule texts meet nothing. exact: texts are compared as they are, white space
    at their ends too."""
    bare = strip(F.col("text"))
    return rules.withColumn("_key", F.col("text") if exact else bare).filter(F.length(bare) > 0)


def _near(rule, sized: bool):
    """Whether a rule's place, and its size if rules are sized, fit the row; rule gives its fields."""
    at = rule("at")
    near = at.isNull() | (F.abs(F.col("x0") - at[0]) <= AT_TOL) & (F.abs(F.col("y0") - at[1]) <= AT_TOL)
    return near & (rule("pt").isNull() | (F.abs(rule("pt") - F.col("size")) <= PT_TOL)) if sized else near


def _met(rows: DataFrame, rules: DataFrame, text: str, exact: bool = False, order: tuple = ()) -> DataFrame:
    """rows with _paged and _any: the rules for the row's page, and those for any page, that meet it, as structs led by the columns in
    order. A text's rules for a page are one row to join with, and so are its rules for any page, each different one once:
    a text that recurs over a document meets neither its other pages' rules nor a rule again and again."""
    r, sized = _told(rules, exact), "pt" in rules.columns
    each = F.collect_set(F.struct(*order, *(["pt"] if sized else []), "at"))
    paged = r.filter("page is not null").groupBy("doc_id", F.col("page").alias("page_no"), "_key").agg(each.alias("_paged"))
    anywhere = r.filter("page is null").groupBy("doc_id", "_key").agg(each.alias("_any"))
    out = rows.withColumn("_key", F.col(text) if exact else strip(F.col(text)))
    out = out.join(paged, ["doc_id", "page_no", "_key"], "left").join(anywhere, ["doc_id", "_key"], "left")
    return out.select(*rows.columns, *(F.filter(c, lambda k: _near(lambda n: k[n], sized)).alias(c) for c in ("_paged", "_any")))


def excluded(rows: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """The rows that an exclusion rule meets."""
    return _met(rows, rules, text).filter((F.size("_paged") > 0) | (F.size("_any") > 0)).select(*rows.columns)


def unused(rows: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """The rules for one page that meet no row; rules for any page are not missed on one."""
    r = _told(rules.filter("page is not null"), False)
    r = r.select(*(F.col(c).alias(f"r_{c}") for c in r.columns))
    keyed = rows.select("doc_id", "page_no", strip(F.col(text)).alias("_key"), "x0", "y0", *(["size"] if "pt" in rules.columns else []))
    on = (F.col("r_doc_id") == F.col("doc_id")) & (F.col("r_page") == F.col("page_no")) & (F.col("r__key") == F.col("_key")) & _near(lambda n: F.col(f"r_{n}"), "pt" in rules.columns)
    return r.join(keyed, on, "left_anti").select(*(F.col(f"r_{c}").alias(c) for c in rules.columns))


def override_kinds(blocks: DataFrame, rules: DataFrame, key: list[str], forced: str | None = None) -> DataFrame:
    """Replaces kind by the first rule that fits, rules for one page before rules for any page. Texts are compared as they are; rules
    with a kind that there is not don't count. forced: name of a column for the rule's kind, null where no rule fits."""
    r = rules.filter(F.col("kind").isin(*KINDS))
    met = _met(blocks, r, "raw", exact=True, order=("rule_ord", "kind"))
    first = [F.get(F.array_sort(c), 0)["kind"] for c in ("_paged", "_any")]
    return met.withColumn("_kind", F.coalesce(*first)).withColumn("kind", F.coalesce("_kind", "kind")).select(*blocks.columns, *([F.col("_kind").alias(forced)] if forced else []))


def join_blocks(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """group: blocks of a page that rules (doc_id, page, a, b) join, each to the visible block before it. Wholly excluded
    blocks (hidden) are looked through, and stand alone."""
    live = Window.partitionBy("doc_id", "page_no", "hidden").orderBy("ord")
    r = rules.select("doc_id", F.col("page").alias("page_no"), F.col("a").alias("_a"), F.col("b").alias("raw")).distinct().withColumn("_hit", F.lit(1))
    out = blocks.withColumn("_a", F.when(~F.col("hidden"), F.lag("raw").over(live))).join(r, ["doc_id", "page_no", "_a", "raw"], "left")
    return out.withColumn("group", F.when(~F.col("hidden"), F.sum(F.when(F.col("_hit") == 1, 0).otherwise(1)).over(live))).drop("_a", "_hit")


def manual_order(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Orders a page's blocks by rule keys: the k-th block of a text takes the k-th key of that text; others follow the matched block
    before them (those before any come first). rules: doc_id, page_no, keys; position counts from 0."""
    same = Window.partitionBy("doc_id", "page_no", "raw").orderBy("ord")
    keys = rules.select("doc_id", "page_no", F.posexplode("keys").alias("rank", "raw"))
    keys = keys.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "page_no", "raw").orderBy("rank")))
    w = Window.partitionBy("doc_id", "page_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumn("_k", F.row_number().over(same)).join(keys, ["doc_id", "page_no", "raw", "_k"], "left")
    out = out.withColumn("_last", F.coalesce(F.last("rank", True).over(w), F.lit(-1)))
    return out.withColumn("position", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("_last", "ord")) - 1).drop("_k", "_last", "rank")


def reasons(rules: dict[str, DataFrame]) -> DataFrame:
    """op, reason, n; a blank reason counts as unset."""
    every = None
    for op, table in rules.items():
        one = table.select(F.lit(op).alias("op"), F.coalesce(F.when(F.length(F.trim("reason")) > 0, F.col("reason")), F.lit("unset")).alias("reason"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("op", "reason").agg(F.count("*").alias("n"))
