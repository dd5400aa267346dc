"""Sinks: CSV with a byte order mark, tagged text, split exports, workbooks, versioned settings, caches."""

from __future__ import annotations

import re
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import FORBIDDEN, cache_state

#: Rows that one sheet can hold, a limit of the format.
SHEET_ROWS = 1_048_576
UNIT_COLUMNS = ["doc_id", "company", "year", "grp", "unit_id", "page_no", "last_page", "page_label", "section", "kind", "rule", "manual", "merge_reason", "adopted", "reason", "n_hits", "hit_words", "n_sentences", "n_chars", "hit_text", "text"]


def named(path: str, label: str = "") -> str:
    """A path with a label before its end; labels may not leave the folder."""
    if re.search(FORBIDDEN, label):
        raise ValueError(f"label {label!r} has a forbidden character")
    return f"{path}_{label}" if label else path


def write_csv(rows: DataFrame, path: str, columns: list[str], order: list[str] | None = None, overwrite: bool = False) -> None:
    """Columns of rows, as files in order that each start with a byte order mark and the header. The mark rides on the first name,
    so executors write it. Other columns are left out; an existing target is an error unless overwrite is set."""
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    out = out.select(F.col(columns[0]).alias("﻿" + columns[0]), *columns[1:])
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def write_tagged(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Lines (doc_id, ord, part, line) of the text export, in order over the files."""
    order = ["doc_id", "ord", "part"]
    out = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line")
    out.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_texts(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """The same lines, a folder for each document, in order over its files."""
    order = ["doc_id", "ord", "part"]
    out = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "line")
    out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("doc_id").text(path)


def export_units(units: DataFrame, docs: DataFrame) -> DataFrame:
    """The record of all units, those not adopted too, with their anchor if they have one. docs: doc_id, company, year, grp."""
    out = units.join(docs.select("doc_id", "company", "year", "grp"), "doc_id", "left").withColumn("page_label", F.col("page_no").cast("string") if "page_label" not in units.columns else F.col("page_label"))
    out = out.withColumn("manual", F.when(F.col("merged"), "merge").otherwise("")).withColumn("adopted", F.when(F.col("adopted"), "○").otherwise("excluded"))
    return out.withColumn("unit_id", F.concat_ws("-", "doc_id", "unit_id")).select(*UNIT_COLUMNS, *(["anchor"] if "anchor" in units.columns else []))


def split_label(c):
    """A value as a folder name: blank is `unset`, forbidden characters are `_`."""
    return F.regexp_replace(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unset")), FORBIDDEN, "_")


def split_rows(exported: DataFrame, column: str) -> DataFrame:
    """The adopted units with label: the name of the part that they go to."""
    return exported.filter("adopted = '○'").withColumn("label", split_label(F.col(column)))


def write_split(exported: DataFrame, path: str, column: str, overwrite: bool = False) -> None:
    """Adopted units, a folder for each value of a column."""
    out = split_rows(exported, column)
    out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("label").option("header", True).option("escape", '"').csv(path)


def write_xlsx(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One sheet with a header, written on the driver row by row; more rows than a sheet holds are an error, found by a count before."""
    n = rows.count() + 1
    if n > SHEET_ROWS:
        raise ValueError(f"{n} rows; a sheet holds {SHEET_ROWS}")

    def line(values):
        cells = (f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(chr(92) + "x00|[\x01-\x08\x0b-\x1f]", "", "" if v is None else str(v)))}</t></is></c>' for v in values)
        return f"<row>{''.join(cells)}</row>".encode()

    main, kinds = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="units" sheetId="1" r:id="r1"/></sheets></workbook>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{xml}')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>'.encode())
            sheet.write(line(columns))
            for row in rows.select(*columns).toLocalIterator():
                sheet.write(line(row))
            sheet.write(b"</sheetData></worksheet>")


def save_settings(new: DataFrame, path: str) -> None:
    """Adds versions (doc_id, saved_at, settings); earlier ones stay as backups."""
    new.write.mode("append").parquet(path)


def latest_settings(history: DataFrame) -> DataFrame:
    """Of each document the version saved last; of versions of one moment the last by number, where there is one."""
    order = ["saved_at", *(["version"] if "version" in history.columns else [])]
    return history.groupBy("doc_id").agg(F.max_by(F.struct(*history.columns), F.struct(*order)).alias("s")).select("s.*")


def current_settings(spark: SparkSession, path: str) -> DataFrame:
    return latest_settings(spark.read.parquet(path))


def check_keywords(words: list[str]) -> list[str]:
    """Keywords as they are saved: trimmed, no blanks, at least one."""
    kept = [w.strip() for w in words if w.strip()]
    if not kept:
        raise ValueError("no keyword left")
    return kept


def context_arguments(n, words: str | None) -> tuple[int, list[str]]:
    """Half-width of windows, from 0 to 8, and keywords parted by comma, ideographic comma or newline."""
    return max(0, min(8, int(n))), [w.strip() for w in re.split(r"[,、\n]", words or "") if w.strip()]


def write_cache(rows: DataFrame, path: str) -> None:
    """Sentences of documents, in place of earlier ones of these documents and of no others."""
    rows.repartition("doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def read_cache(docs: DataFrame, manifest: DataFrame, path: str, schema: str) -> DataFrame:
    """Sentences of the documents (doc_id, mtime, sig) whose cache is of the same contents and settings. schema: that of the rows, as a text,
    since doc_id is the name of a folder."""
    good = cache_state(docs, manifest).filter("state = 'ok'").select("doc_id")
    return docs.sparkSession.read.schema(schema).parquet(path).join(good, "doc_id", "left_semi")


def payload(units: DataFrame) -> DataFrame:
    """doc_id, unit_id, json of each unit."""
    return units.select("doc_id", "unit_id", F.to_json(F.struct(*units.columns)).alias("json"))


def write_windows(windows: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    """Context windows, numbered with their document's name."""
    write_csv(windows.withColumn("window_id", F.concat_ws("-", "doc_id", "window_id")), path, columns, None, overwrite)


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place in their document, from 0."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)
