"""What is said of whole pages and documents: pages to skip, summaries, status of tasks, run log, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..params import KINDS

PAGE = ["doc_id", "page_no"]
#: What headings of pages say that are worth skipping, by reason, in the order tried; then the word for contents.
HEADINGS = {
    "policy": r"編集方針|報告(方針|対象|範囲|期間)|(本|この)(レポート|報告書|サイト)について|レポートの(発行|概要|読み方)|Editorial Policy|About (this|the) Report",
    "index": r"対照表|内容索引|Content Index|SASB|ESGデータ|データ(集|編|一覧)|非財務データ|KPI一覧|Data Section",
    "assurance": r"第三者保証|独立(した)?第三者|保証報告書|第三者検証|第三者意見|Independent Assurance|Assurance (Statement|Report)",
}
CONTENTS = r"(?iu)^(目\s*次|もくじ|CONTENTS?|INDEX)$"


def _biggest():
    """Texts of the largest size so far, in the order of the lines: over half a point more starts anew, within half a point joins."""
    start = F.struct(F.lit(0.0).alias("size"), F.array().cast("array<string>").alias("texts"))
    more = lambda s, n: F.struct(n["size"].alias("size"), F.array(n["text"]).alias("texts"))
    same = lambda s, n: F.struct(s["size"].alias("size"), F.concat(s["texts"], F.array(n["text"])).alias("texts"))
    step = lambda s, n: F.when(n["size"] > s["size"] + 0.5, more(s, n)).when(F.abs(n["size"] - s["size"]) <= 0.5, same(s, n)).otherwise(s)
    return F.aggregate("_lines", start, step)["texts"]


def page_features(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Counts of a page and its headings. lines: size is the largest of the line's spans; blank lines do not count. body: doc_id, body."""
    text = strip(F.col("text"))
    rows = lines.withColumn("text", text).filter(F.length("text") > 0).withColumn("size", F.col("size").cast("double")).join(body, "doc_id")
    by = rows.groupBy(*PAGE).agg(
        F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("text").rlike(r"(?U)\d{1,3}\s*$")).alias("n_tails"),
        F.max(F.col("size") >= F.col("body") * 1.8).alias("has_big"), F.first("body").alias("body"), F.array_sort(F.collect_list(F.struct("ord", "text", "size"))).alias("_lines"),
    )
    heads = F.transform(F.filter("_lines", lambda n: n["size"] >= F.col("body") + 3), lambda n: n["text"])
    return by.withColumn("heads", heads).withColumn("biggest", _biggest()).drop("_lines", "body")


def suggest_skips(pages: DataFrame, features: DataFrame) -> DataFrame:
    """doc_id, page_no, reason, why: pages that may be skipped. pages: every page of every document, also blank ones."""
    n = pages.withColumn("_n", F.max("page_no").over(Window.partitionBy("doc_id"))).join(features, PAGE, "left").fillna(0, ["n_lines", "n_chars", "n_tails"]).fillna(False, ["has_big"])
    early = F.col("page_no") <= F.greatest(F.lit(10.0), F.col("_n") * 0.15)
    joined = F.array_join(F.coalesce("heads", F.array().cast("array<string>")), "／")
    titled = early & F.coalesce(F.exists("biggest", lambda t: t.rlike(CONTENTS)), F.lit(False))
    listed = early & (F.col("n_lines") >= 10) & (F.try_divide("n_tails", "n_lines") >= 0.4)
    said = lambda reason, why: F.struct(F.lit(reason).alias("reason"), why.alias("why"))
    found = F.when(F.col("page_no") == 1, said("cover", F.lit("first page")))
    found = found.when((F.col("page_no") == F.col("_n")) & (F.col("n_chars") < 300), said("cover", F.concat(F.lit("last page of "), F.col("n_chars").cast("string"), F.lit(" characters"))))
    found = found.when(titled, said("contents", F.lit("largest heading")))
    found = found.when(listed, said("contents", F.concat(F.floor(F.try_divide(F.col("n_tails") * 100, F.col("n_lines"))).cast("string"), F.lit("% of lines end in a number"))))
    for reason, pattern in HEADINGS.items():
        found = found.when(joined.rlike(f"(?iu){pattern}"), said(reason, F.concat(F.lit("heading: "), F.regexp_extract(joined, f"(?iu)({pattern})", 1))))
    found = found.when((F.col("n_chars") < 250) & (F.col("n_lines") <= 12) & F.col("has_big"), said("divider", F.concat(F.col("n_chars").cast("string"), F.lit(" characters under a large heading"))))
    return n.withColumn("_f", found).filter("_f is not null").select(*PAGE, "_f.reason", "_f.why")


def page_summary(pages: DataFrame, blocks: DataFrame, tables: DataFrame, skips: DataFrame) -> DataFrame:
    """A row for each page: units left by kind and in all, tables, first section heading, and why it may be skipped ('' if not)."""
    left = F.size(F.filter("units", lambda u: ~u["excluded"]))
    heading = F.when(F.col("is_section"), strip(F.col("raw")))
    kinds = blocks.groupBy(*PAGE).agg(*(F.sum(F.when(F.col("kind") == k, left).otherwise(0)).alias(k) for k in KINDS), F.sum(left).alias("total"), F.min_by(heading, F.when(heading.isNotNull(), F.col("ord"))).alias("section"))
    n = tables.groupBy(*PAGE).agg(F.count("*").alias("n_tables"))
    out = pages.select(*PAGE).join(kinds, PAGE, "left").join(n, PAGE, "left").join(skips.select(*PAGE, "reason", "why"), PAGE, "left")
    return out.fillna(0, [*KINDS, "total", "n_tables"]).fillna("", ["section", "reason", "why"])


def task_status(docs: DataFrame, tasks: list[str], skips: DataFrame, notes: DataFrame, states: tuple[str, ...] = ("none", "kept")) -> DataFrame:
    """State of each task of a document: `skipped` with its pages, a recorded state, or `unchecked`. Of several rules for a page the last
    counts; of several notes the last. skips: doc_id, page, reason, rule_ord; notes: doc_id, task, state, memo, rule_ord."""
    every = docs.select("doc_id", F.posexplode(F.array(*map(F.lit, tasks))).alias("task_no", "task"))
    of_page = skips.groupBy("doc_id", "page").agg(F.max_by(F.coalesce("reason", F.lit("")), "rule_ord").alias("task"))
    of_task = of_page.groupBy("doc_id", "task").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    note = notes.groupBy("doc_id", "task").agg(F.max_by(F.struct("state", "memo"), "rule_ord").alias("note"))
    out = every.join(of_task, ["doc_id", "task"], "left").join(note, ["doc_id", "task"], "left")
    known = F.col("note.state").isin(*states)
    state = F.when(F.col("pages").isNotNull(), "skipped").when(known, F.col("note.state")).otherwise("unchecked")
    memo = F.when(F.col("pages").isNotNull() | known, F.coalesce("note.memo", F.lit(""))).otherwise("")
    return out.select("doc_id", "task_no", "task", state.alias("state"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"), memo.alias("memo"))


def run_log(docs: DataFrame, rows: DataFrame, units: DataFrame) -> DataFrame:
    """Counters of each document of a run, zeros where it has no rows. docs: doc_id and whatever else to carry."""
    n_pages = F.countDistinct("page_no")
    by = rows.groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"), n_pages.alias("n_page_units"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS),
        F.countDistinct(F.nullif("section", F.lit(""))).alias("n_sections"), F.sum(F.length("sentence")).alias("n_chars"),
    )
    out = docs.join(by, "doc_id", "left").join(units.groupBy("doc_id").agg(F.count("*").alias("n_units")), "doc_id", "left")
    out = out.fillna(0, ["n_sentences", "n_page_units", *KINDS, "n_sections", "n_chars", "n_units"])
    return out.withColumn("sentences_per_page", F.coalesce(F.bround(F.try_divide("n_sentences", "n_page_units"), 1), F.lit(0.0)))


def audit(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Units of each document, those done (checked or not adopted), those left; documents without units count zero."""
    done = F.col("checked") | ~F.col("adopted")
    by = units.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("adopted")).alias("n_adopted"), F.count_if(F.col("checked")).alias("n_checked"), F.count_if(done).alias("done"))
    out = docs.select("doc_id").join(by, "doc_id", "left").fillna(0, ["total", "n_adopted", "n_checked", "done"])
    return out.withColumn("left_over", F.col("total") - F.col("done"))


def progress(blocks: DataFrame) -> DataFrame:
    """Blocks of each document by what was done: total, excluded, checked (columns of blocks), done (no more than there are)."""
    n = F.count("*")
    return blocks.groupBy("doc_id").agg(n.alias("total"), F.count_if("excluded").alias("excluded"), F.count_if("checked").alias("checked"), F.least(n, F.count_if("excluded") + F.count_if("checked")).alias("done"))


def review_seconds(checks: DataFrame) -> DataFrame:
    """Mean seconds of a document's checks, to a tenth; those without a positive time don't count."""
    return checks.groupBy("doc_id").agg(F.round(F.avg(F.when(F.col("seconds") > 0, F.col("seconds"))), 1).alias("seconds"))


def export_breakdown(rows: DataFrame) -> DataFrame:
    """Sentences of each document by kind, and characters in all."""
    return rows.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), F.count("*").alias("total"), F.sum(F.length("sentence")).alias("n_chars"))


def todo_only(units: DataFrame) -> DataFrame:
    """Units not checked and not left out: documents without any go with their units."""
    return units.filter(~F.col("checked") & F.col("adopted"))


def next_todo(units: DataFrame) -> DataFrame:
    """The first unit not done, by document and number."""
    return units.filter(~F.col("checked") & F.col("adopted")).orderBy("doc_id", "unit_id").limit(1)


def hits_by_page(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.filter(F.col("sentence").rlike(pattern)).groupBy(*PAGE).agg(F.count("*").alias("n_hits"))


def document_info(docs: DataFrame, histogram: DataFrame, body: DataFrame, top: int = 14) -> DataFrame:
    """docs with the body size and the sizes with most characters (the first seen on ties)."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("chars"), "first_ord")
    best = histogram.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top)
    sizes = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "size", "chars", "share"))).alias("sizes"))
    return docs.join(body, "doc_id", "left").join(sizes, "doc_id", "left").fillna(0.0, ["body"])
