"""The write side of recorded corrections: each function takes rule tables and returns the new rules. Null in a rule means any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The lists that a reset empties; parameters and records of judgement stay.
MANUAL = ("excluded", "joins", "splits", "kinds", "manual_order", "tables", "table_off", "unit_merges", "unit_excludes")


def _wild(a, b):
    return a.isNull() | b.isNull() | (a == b)


def _as(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{prefix}{c}") for c in rows.columns))


def _covers(near: float = 1.0):
    """A rule (r_) and a row (n_) that mean the same text, page, size and place, where either may leave one open."""
    at = F.col("r_at").isNull() | F.col("n_at").isNull() | ((F.abs(F.col("r_at")[0] - F.col("n_at")[0]) <= near) & (F.abs(F.col("r_at")[1] - F.col("n_at")[1]) <= near))
    return (F.col("r_doc_id") == F.col("n_doc_id")) & (F.col("r_text") == F.col("n_text")) & _wild(F.col("r_page"), F.col("n_page")) & _wild(F.col("r_pt"), F.col("n_pt")) & at


def exclude(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the new exclusions that no rule covers."""
    fresh = _as(new, "n_").join(_as(rules, "r_"), _covers(), "left_anti")
    return rules.unionByName(fresh.select(*(F.col(f"n_{c}").alias(c) for c in new.columns)), allowMissingColumns=True)


def restore(rules: DataFrame, rows: DataFrame) -> DataFrame:
    """R2: takes away every rule that covers one of the rows, open ones too."""
    return _as(rules, "r_").join(_as(rows, "n_"), _covers(), "left_anti").select(*(F.col(f"r_{c}").alias(c) for c in rules.columns))


def join(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Adds pairs (doc_id, page, a, b) not yet joined."""
    return rules.unionByName(new.join(rules, ["doc_id", "page", "a", "b"], "left_anti"), allowMissingColumns=True)


def unjoin(rules: DataFrame, blocks: DataFrame) -> DataFrame:
    """Takes away rules whose two sides are both parts of a block (doc_id, page, parts)."""
    b = blocks.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "parts")
    on = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & F.expr("array_contains(parts, a)") & F.expr("array_contains(parts, b)")
    return rules.join(b, on, "left_anti")


def replace(rules: DataFrame, new: DataFrame, key: list[str], keep_reason: bool = True) -> DataFrame:
    """One rule for each key, the new one; a blank new reason takes over the old rule's."""
    if keep_reason and {"reason"} <= set(rules.columns) & set(new.columns):
        same = [F.col(f"n_{c}").eqNullSafe(F.col(f"o_{c}")) for c in key]
        on = same[0]
        for s in same[1:]:
            on = on & s
        reason = F.coalesce(F.nullif(F.trim("n_reason"), F.lit("")), "o_reason", F.lit(""))
        old = _as(rules, "o_").groupBy(*(f"o_{c}" for c in key)).agg(F.max("o_reason").alias("o_reason"))
        fresh = _as(new, "n_").join(old, on, "left").select(*((reason if c == "reason" else F.col(f"n_{c}")).alias(c) for c in new.columns))
    else:
        fresh = new
    return remove(rules, new, key).unionByName(fresh, allowMissingColumns=True)


def remove(rules: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Takes away the rules with these keys; null equals null only."""
    r, g = _as(rules, "r_"), _as(gone.select(*key).distinct(), "g_")
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"r_{c}").eqNullSafe(F.col(f"g_{c}"))
    return r.join(g, on, "left_anti").select(*(F.col(f"r_{c}").alias(c) for c in rules.columns))


def set_kind(rules: DataFrame, new: DataFrame) -> DataFrame:
    """New has doc_id, page, text, at, kind, auto, reason; a kind that is the automatic one takes the rule away."""
    key = ["doc_id", "page", "text", "at"]
    return replace(remove(rules, new, key), new.filter("kind <> auto").drop("auto"), key)


def split(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Adds a cut before a line, where 1 <= line < n_lines."""
    return rules.unionByName(new.filter((F.col("line") >= 1) & (F.col("line") < F.col("n_lines"))).drop("n_lines"), allowMissingColumns=True)


def order(rules: DataFrame, new: DataFrame) -> DataFrame:
    """One order for each page; an empty list of keys puts the page back."""
    key = ["doc_id", "page"]
    return replace(remove(rules, new, key), new.filter(F.size("keys") > 0), key)


def add_table(rules: DataFrame, boxes: DataFrame, pad: float = 0.0) -> DataFrame:
    """A table by hand round the selected boxes (doc_id, page, x0, y0, x1, y1), read by its text."""
    one = boxes.groupBy("doc_id", "page").agg(F.array(F.min("x0") - pad, F.min("y0") - pad, F.max("x1") + pad, F.max("y1") + pad).alias("rect"))
    return rules.unionByName(one.withColumn("strategy", F.lit("text")), allowMissingColumns=True)


def toggle(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pages whose tables are off; chosen ones change sides."""
    key = ["doc_id", "page"]
    return pages.join(chosen, key, "left_anti").select(*key).unionByName(chosen.join(pages, key, "left_anti").select(*key).distinct())


def merge(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds (add = true) or takes away sentences of a unit (doc_id, page, hit, text, add); a rule left empty goes. Sentences keep their
    order, new ones come last; reasons stay."""
    old = rules.select("doc_id", "page", "hit", F.posexplode("add").alias("k", "text"))
    drop, more = changes.filter("not add"), changes.filter("add").select("doc_id", "page", "hit", F.lit(1 << 30).alias("k"), "text")
    key = ["doc_id", "page", "hit", "text"]
    rows = old.join(drop, key, "left_anti").select(*key, "k").unionByName(more.select(*key, "k"))
    rows = rows.groupBy(*key).agg(F.min("k").alias("k"))
    kept = rows.groupBy("doc_id", "page", "hit").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("add"))
    reasons = rules.groupBy("doc_id", "page", "hit").agg(F.max("reason").alias("reason"))
    return kept.join(reasons, ["doc_id", "page", "hit"], "left").fillna("", ["reason"])


def reason(rules: DataFrame, chosen: DataFrame, key: list[str], text: str) -> DataFrame:
    """One reason for the chosen rules."""
    marks = _as(chosen.select(*key).distinct(), "g_").withColumn("_hit", F.lit(True))
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return rules.join(marks, on, "left").withColumn("reason", F.when(F.col("_hit"), F.lit(text)).otherwise(F.col("reason"))).select(*rules.columns)


def reset(rules: dict[str, DataFrame], doc_id) -> dict[str, DataFrame]:
    """No manual edit of a document stays."""
    return {op: t.filter(F.col("doc_id") != doc_id) if op in MANUAL else t for op, t in rules.items()}


def doubles(rules: DataFrame) -> DataFrame:
    """Whether another rule shares text, page and size, so that its place has to be shown."""
    return rules.withColumn("shared", F.count("*").over(Window.partitionBy("doc_id", "text", "page", "pt")) > 1)


def totals(rules: dict[str, DataFrame]) -> DataFrame:
    """Rules by operation and document, and over all operations (op null)."""
    every = None
    for op, t in rules.items():
        one = t.select("doc_id", F.lit(op).alias("op"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("doc_id", "op").count().unionByName(every.groupBy("doc_id").count().withColumn("op", F.lit(None).cast("string")))
