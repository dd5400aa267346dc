"""Sources: directories of documents, settings, keywords, groups, caches."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..params import KEYWORDS

FORBIDDEN = r'[\\/:*?"<>|]'
#: Fields of settings that do not change the sentences of a document, and so stay out of its signature.
RECORDS = ("unit_merges", "unit_excludes", "unit_checks", "boundary_check", "task_states", "skip_pages")
SETTINGS = """repeat_ratio double, size_tol double, tiny_ratio double, col_tol double, line_gap double, join_gap double, min_len int, body_size double, section_min_pt double,
section_max_len int, table_strategy string, order string, auto_join boolean, skip_pages array<string>, task_states array<struct<key:string,state:string,memo:string>>,
excluded array<struct<text:string,page:int,pt:double,at:array<double>,reason:string>>, joins array<struct<page:int,a:string,b:string,reason:string>>,
splits array<struct<page:int,text:string,at:array<double>,line:int,reason:string>>, kinds array<struct<page:int,text:string,at:array<double>,kind:string,reason:string>>,
manual_order array<struct<page:int,keys:array<string>,reason:string>>, tables array<struct<page:int,rect:array<double>,strategy:string,reason:string>>, table_off array<struct<page:int,reason:string>>,
unit_merges array<struct<page:int,hit:string,add:array<string>,reason:string>>, unit_excludes array<struct<page:int,text:string,reason:string>>,
unit_checks array<struct<page:int,hit:string,seconds:double,day:string>>"""


def parse_name(stem: Column) -> list[Column]:
    """company and year of `company_year`; other names are the company, without a year."""
    good = stem.rlike(r"^.+_\d{4}$")
    return [F.when(good, F.regexp_extract(stem, r"^(.+?)_(\d{4})$", 1)).otherwise(stem).alias("company"), F.when(good, F.right(stem, F.lit(4))).otherwise("").alias("year")]


def documents(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Files of a folder by name: doc_id, file, company, year, mtime, size_mb. Their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "modificationTime", "length")
    name = F.url_decode(F.regexp_replace(F.substring_index("path", "/", -1), r"\+", "%2B"))
    out = files.withColumn("file", name).withColumn("doc_id", F.expr(f"left(file, length(file) - {len(suffix)})"))
    return out.select("doc_id", "file", *parse_name(F.col("doc_id")), F.col("modificationTime").alias("mtime"), F.round(F.col("length") / 1048576, 1).alias("size_mb")).orderBy("file")


def migrate_skips(c: Column) -> Column:
    """Pages to skip as JSON texts, bare numbers or objects: to (page, reason), without pages that are null, by page."""
    old = F.transform(c, lambda x: F.coalesce(F.when(x.try_cast("int").isNotNull(), F.struct(x.try_cast("int").alias("page"), F.lit("").alias("reason"))), F.from_json(x, "page int, reason string")))
    new = F.transform(old, lambda x: F.struct(x["page"].alias("page"), F.coalesce(x["reason"], F.lit("")).alias("reason")))
    return F.array_sort(F.filter(new, lambda x: x["page"].isNotNull()))


def parse_settings(texts: DataFrame, column: str = "json") -> DataFrame:
    """settings of JSON texts: unknown keys drop, absent ones are null, skip_pages of any age are (page, reason)."""
    parsed = texts.withColumn("settings", F.from_json(column, SETTINGS))
    return parsed.withColumn("settings", F.col("settings").withField("skip_pages", migrate_skips(F.col("settings.skip_pages")))).drop(column)


def settings(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, settings: one JSON file a document."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select(F.url_decode(F.regexp_replace(F.substring_index("_metadata.file_name", "/", -1), r"\+", "%2B")).alias("f"), F.col("value").alias("json"))
    return parse_settings(files.select(F.expr("left(f, length(f) - 5)").alias("doc_id"), "json"))


def rules(parsed: DataFrame, op: str) -> DataFrame:
    """The rule table of one operation: doc_id, rule_ord and the rule's fields."""
    return parsed.select("doc_id", F.posexplode(f"settings.{op}").alias("rule_ord", "_r")).select("doc_id", "rule_ord", "_r.*")


def keywords(spark: SparkSession, path: str | None, default: list[str] | None = None) -> list[str]:
    """A JSON list of keywords, trimmed, without blanks; the default if there is none. Keywords are few: they make up one pattern."""
    default = list(default or KEYWORDS)
    if path is None:
        return default
    text = spark.read.option("wholetext", True).text(path)
    row = text.select(F.filter(F.transform(F.from_json("value", "array<string>"), strip), lambda w: F.length(w) > 0).alias("w")).first()
    return list(row["w"]) if row and row["w"] else default


def groups(spark: SparkSession, path: str) -> DataFrame:
    """key, grp of a CSV with company, year, grp; a byte order mark at its head is no part of a name."""
    table = spark.read.option("header", True).csv(path)
    return table.select(F.concat_ws("_", "company", "year").alias("key"), F.coalesce("grp", F.lit("")).alias("grp")).dropDuplicates(["key"])


def with_group(docs: DataFrame, table: DataFrame) -> DataFrame:
    return docs.join(table, docs["doc_id"] == table["key"], "left").drop("key").fillna("", ["grp"])


def signature(parsed: Column, fields: list[str]) -> Column:
    """Digest of what decides a document's sentences: the settings but for records, in order of their names."""
    return F.sha2(F.to_json(F.struct(*(parsed[f].alias(f) for f in sorted(set(fields) - set(RECORDS))))), 256)


def cache_state(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """docs (doc_id, mtime, sig) with state: ok, stale or none, by the manifest of what was built."""
    m = manifest.select("doc_id", F.col("mtime").alias("_m"), F.col("sig").alias("_s"), F.lit(True).alias("_has"))
    same = F.col("_m").eqNullSafe(F.col("mtime")) & F.col("_s").eqNullSafe(F.col("sig"))
    return docs.join(m, "doc_id", "left").withColumn("state", F.when(F.col("_has").isNull(), "none").when(same, "ok").otherwise("stale")).drop("_m", "_s", "_has")


def listing(docs: DataFrame, saved: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents with their badges: saved settings, counts of units, cache state. manifest: doc_id, mtime, sig, n_units, n_adopted, n_checked."""
    out = cache_state(docs, manifest).join(saved.select("doc_id").distinct().withColumn("saved", F.lit(True)), "doc_id", "left")
    return out.join(manifest.select("doc_id", "n_units", "n_adopted", "n_checked"), "doc_id", "left").fillna(False, ["saved"]).orderBy("doc_id")


def check_uploads(new: DataFrame, present: DataFrame) -> DataFrame:
    """new (company, year, head: first bytes) with doc_id and error: null if the file may be stored."""
    company, year = strip(F.col("company")), strip(F.col("year"))
    known = present.select("doc_id", F.lit(True).alias("_has")).distinct()
    out = new.withColumn("doc_id", F.concat_ws("_", company, year)).join(known, "doc_id", "left")
    bad = F.when(F.coalesce(company, F.lit("")) == "", "no company").when(~F.coalesce(year.rlike(r"^\d{4}$"), F.lit(False)), "year is not four digits")
    bad = bad.when(company.rlike(FORBIDDEN), "forbidden character").when(F.col("_has"), "exists").when(~F.coalesce(F.hex("head").startswith("25504446"), F.lit(False)), "no PDF")
    return out.withColumn("error", bad).drop("_has")


@dataclass(frozen=True)
class Span:
    """A piece of a line of one font; the box is the line's."""

    doc_id: str
    page_no: int
    block_ord: int
    line_ord: int
    span_ord: int
    x0: float
    y0: float
    x1: float
    y1: float
    size: float
    flags: int
    font: str
    text: str


SPAN = "doc_id string, page_no int, block_ord int, line_ord int, span_ord int, x0 double, y0 double, x1 double, y1 double, size double, flags int, font string, text string"


def sample_spans(spark: SparkSession, doc_id: str = "Sample_2024") -> DataFrame:
    """A document of three pages: a cover, two columns with a running head, a ruled table."""
    made = []

    def line(page, block, n, x, y, size, text):
        made.append(Span(doc_id, page, block, n, 0, x, y, x + size * len(text), y + size, size, 0, "Plain", text))

    line(1, 0, 0, 60.0, 200.0, 26.0, "集成報告")
    line(1, 1, 0, 60.0, 260.0, 16.0, "二〇二四年")
    line(2, 0, 0, 40.0, 24.0, 7.0, "集成報告 二〇二四")
    line(2, 1, 0, 40.0, 60.0, 16.0, "経営の方針")
    for block, (x, texts) in enumerate([(40.0, ["当社は生成AIを活用し、業務の", "効率を高めています。社員の", "学びも支えています。"]), (320.0, ["研究では大規模言語モデルを", "用いた検証を続けており、成", "果を公開しています。"])], 2):
        for n, text in enumerate(texts):
            line(2, block, n, x, 90.0 + 13.5 * n, 9.0, text)
    line(3, 0, 0, 40.0, 60.0, 16.0, "指標")
    for i, row in enumerate([["項目", "目標", "実績"], ["排出量", "一〇", "九"], ["LLM研修", "百人", "八十人"]]):
        for j, text in enumerate(row):
            line(3, 1 + i, j, (45.0, 205.0, 385.0)[j], 95.0 + 30 * i, 8.5, text)
    return spark.createDataFrame([tuple(asdict(s).values()) for s in made], SPAN)
