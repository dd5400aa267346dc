"""The whole corpus at once: what each export holds, all exports written to a folder, and sentences looked up in the cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_pattern
from ..operators import pages as G
from ..operators import sentences as S
from ..operators.folds import units_with_edits
from ..params import KINDS
from ..sources import files, sinks
from ..streaming.incremental import warm
from .extract import cut

NAME = ["company", "year", "grp"]
#: The columns of each export, in order, and the columns that order its rows.
COLUMNS = {
    "sentences": [*NAME, "page_no", "page_label", "section", "kind", "pt", "sentence"],
    "pages": [*NAME, "page_no", "page_label", "section", "kind", "n_sentences", "n_chars", "body"],
    "document_vars": ["doc_id", *NAME],
    "page_vars": ["doc_id", *NAME, "page_no", "page_label", "section", "kind", "n_sentences"],
    "log": ["file", *NAME, "n_pages", "body_pt", "settings", "n_sentences", "n_units", "n_page_units", "sentences_per_page", *KINDS, "n_sections", "n_chars"],
    "units": sinks.UNIT_COLUMNS,
    "rates": ["doc_id", *NAME, "n_sentences", "n_hit_sentences", "sentence_rate_pct", "n_pages", "n_hit_pages", "page_rate_pct"],
}
ORDER = {"sentences": ["doc_id", "ord"], "pages": ["doc_id", "page_no"], "document_vars": ["doc_id"], "page_vars": ["doc_id", "page_no"], "log": ["doc_id"], "units": ["doc_id", "anchor"], "rates": ["doc_id"]}


def described(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """docs with company and year of their names and grp, '' without groups. groups: those of files.groups."""
    named = docs.drop(*NAME).select("*", *files.parse_name(F.col("doc_id")))
    return files.with_group(named, groups) if groups is not None else named.withColumn("grp", F.lit(""))


def faults(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, error of the documents that can't be analysed: none of their spans is there, or one has no page, box or size. The others go on without
    them."""
    broken = F.lit(False)
    for c in ("page_no", "x0", "y0", "x1", "y1", "size"):
        broken = broken | F.col(c).isNull()
    by = spans.groupBy("doc_id").agg(F.count_if(broken).alias("_broken"))
    out = docs.select("doc_id").join(by, "doc_id", "left")
    error = F.when(F.col("_broken").isNull(), "no spans").when(F.col("_broken") > 0, F.concat(F.col("_broken").cast("string"), F.lit(" spans without page, box or size")))
    return out.select("doc_id", error.alias("error")).filter("error is not null")


def exports(docs: DataFrame, rows: DataFrame, keywords: list[str] | None = None, merges: DataFrame | None = None, excludes: DataFrame | None = None, checks: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of all exports by name (those of COLUMNS, and tagged: doc_id, ord, part, line), with the columns that order them.

    docs: doc_id, file, company, year, grp, n_pages, body_pt, saved (whether it has settings of its own); rows: those of extract. A document
    without sentences has a row in document_vars, log and rates, and a title in tagged, so that titles and document_vars agree.
    Time spent on one document is not known, as all go through one plan."""
    spark, pattern = rows.sparkSession, keyword_pattern(keywords)
    if merges is None:
        merges = spark.createDataFrame([], "page int, hit string, add array<string>, reason string, rule_ord int").withColumn("doc_id", F.lit(None).cast(rows.schema["doc_id"].dataType))
    rows = cut(rows)
    units = units_with_edits(rows, pattern, merges, excludes, checks)
    units = cut(units.join(rows.select("doc_id", F.col("ord").alias("anchor"), "page_label"), ["doc_id", "anchor"]))
    names = docs.select("doc_id", *NAME)
    pages = S.rollup_pages(rows).join(names, "doc_id")
    log = docs.select("doc_id", "file", *NAME, "n_pages", "body_pt", F.when(F.col("saved"), "own").otherwise("default").alias("settings"))
    return {
        "sentences": rows.join(names, "doc_id"),
        "pages": pages,
        "document_vars": names,
        "page_vars": pages,
        "tagged": S.tagged_text(rows, docs),
        "log": G.run_log(log, rows, units),
        "units": sinks.export_units(units, names),
        "rates": S.rates(rows, docs.select("doc_id", "n_pages"), pattern).join(names, "doc_id"),
    }


def write_exports(tables: dict[str, DataFrame], path: str, split: str | None = None, overwrite: bool = False) -> list[str]:
    """Writes each table below path: a folder of CSV files each; tagged as one text over files in order, and texts by document. split: a column of
    the units, whose adopted ones then go to a folder for each of its values. Returns the folders, in the order written."""
    done = []
    for name, columns in COLUMNS.items():
        sinks.write_csv(tables[name], f"{path}/{name}", columns, ORDER[name], overwrite)
        done.append(name)
    sinks.write_tagged(tables["tagged"], f"{path}/tagged", overwrite)
    sinks.write_texts(tables["tagged"], f"{path}/texts", overwrite)
    done += ["tagged", "texts"]
    if split:
        if split not in sinks.UNIT_COLUMNS:
            raise ValueError(f"units have no column {split!r}")
        done.append(sinks.named("units_by", split))
        sinks.write_split(tables["units"].select(*sinks.UNIT_COLUMNS), f"{path}/{done[-1]}", split, overwrite)
    return done


def looked_up(docs: DataFrame, manifest: DataFrame, analyse: Callable[[DataFrame], DataFrame], path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest) of docs (doc_id, mtime, sig): those that are stale are analysed into the cache first, the others are only read."""
    new = cut(warm(docs, manifest, analyse, path))
    kept = manifest.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)
    return sinks.read_cache(docs, kept, path, schema), kept


def counted(manifest: DataFrame, units: DataFrame) -> DataFrame:
    """The manifest with each document's units, those adopted and those checked; zeros without units."""
    by = units.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.count_if("adopted").alias("n_adopted"), F.count_if("checked").alias("n_checked"))
    counts = ["n_units", "n_adopted", "n_checked"]
    return manifest.drop(*counts).join(by, "doc_id", "left").fillna(0, counts)
