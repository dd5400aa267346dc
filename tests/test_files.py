"""Sources, sinks, edits of rules, incremental runs, and a whole extraction of the sample document."""

import json
import zipfile

import pytest

from pagelathe.operators import edits, pages
from pagelathe.plans import extract
from pagelathe.sources import files, sinks
from pagelathe.streaming import incremental


def test_documents_by_name(spark, tmp_path):
    for name in ("b_2023.pdf", "a b+_2024.pdf", "odd.pdf", "x.txt"):
        (tmp_path / name).write_bytes(b"%PDF-")
    assert [(r.doc_id, r.company, r.year) for r in files.documents(spark, str(tmp_path)).collect()] == [("a b+_2024", "a b+", "2024"), ("b_2023", "b", "2023"), ("odd", "odd", "")]


def test_settings(spark, tmp_path):
    (tmp_path / "d 1.json").write_text(json.dumps({"repeat_ratio": 0.4, "old": 1, "skip_pages": [3, {"page": 1, "reason": "cover"}, {"page": None}], "joins": [{"page": 2, "a": "x", "b": "y"}]}))
    parsed = files.settings(spark, str(tmp_path))
    (row,) = parsed.collect()
    assert row.doc_id == "d 1" and row.settings.repeat_ratio == 0.4 and [tuple(p) for p in row.settings.skip_pages] == [(1, "cover"), (3, "")]
    assert [(r.doc_id, r.rule_ord, r.page, r.a, r.b) for r in files.rules(parsed, "joins").collect()] == [("d 1", 0, 2, "x", "y")]
    assert len(parsed.select(files.signature(parsed["settings"], ["order", "joins", "skip_pages"])).first()[0]) == 64


def test_keywords_and_groups(spark, tmp_path):
    (tmp_path / "k.json").write_text('[" LLM ", "", "AI"]')
    assert files.keywords(spark, str(tmp_path / "k.json")) == ["LLM", "AI"] and len(files.keywords(spark, None)) == 11
    (tmp_path / "g.csv").write_text("﻿company,year,grp\na,2024,one\n", encoding="utf-8")
    docs = spark.createDataFrame([("a_2024",), ("b_2024",)], "doc_id string")
    groups = files.groups(spark, str(tmp_path / "g.csv")).withColumnRenamed("key", "doc_id")
    assert sorted(map(tuple, docs.join(groups, "doc_id", "left").collect()), key=str) == [("a_2024", "one"), ("b_2024", None)]


def test_uploads(spark):
    new = spark.createDataFrame([("a", "2024", b"%PDF-1"), ("b", "24", b"%PDF"), ("c/", "2024", b"%PDF"), ("d", "2024", b"GIF"), (" ", "2024", b"%PDF"), ("e", "2024", b"%PDF")], "company string, year string, head binary")
    got = files.check_uploads(new, spark.createDataFrame([("e_2024",)], "doc_id string")).collect()
    assert {r.company: r.error for r in got} == {"a": None, "b": "year is not four digits", "c/": "forbidden character", "d": "no PDF", " ": "no company", "e": "exists"}


def test_csv_with_mark(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'b "q", x'), (1, "a")], "n int, t string")
    path = sinks.named(str(tmp_path / "out"), "v1")
    sinks.write_csv(rows.coalesce(1), path, ["n", "t"], ["n"])
    (part,) = (p for p in (tmp_path / "out_v1").glob("*.csv") if b"a" in p.read_bytes())
    assert part.read_bytes().startswith("﻿n,t\n".encode())
    with pytest.raises(Exception):
        sinks.write_csv(rows, path, ["n"])
    with pytest.raises(ValueError):
        sinks.named("x", "../y")


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "u.xlsx")
    sinks.write_xlsx(spark.createDataFrame([(1, "a<b"), (None, None)], "n int, t string"), path, ["n", "t"])
    with zipfile.ZipFile(path) as z:
        text = z.read("xl/worksheets/sheet1.xml").decode()
    assert text.count("<row>") == 3 and "a&lt;b" in text and "<v>1</v>" in text


def test_settings_history(spark, tmp_path):
    path = str(tmp_path / "h")
    for at, text in ((1, "old"), (2, "new")):
        sinks.save_settings(spark.createDataFrame([("d", at, text)], "doc_id string, saved_at int, settings string"), path)
    assert [tuple(r) for r in sinks.current_settings(spark, path).collect()] == [("d", 2, "new")]


RULE = "doc_id string, text string, page int, pt double, at array<double>, reason string"


def test_edits(spark):
    rules = spark.createDataFrame([("d", "t", None, None, None, ""), ("d", "u", 1, 9.0, [1.0, 2.0], "r")], RULE)
    new = spark.createDataFrame([("d", "t", 3, 9.0, None, ""), ("d", "u", 2, 9.0, None, ""), ("d", "u", 1, 9.0, [1.5, 2.0], "")], RULE)
    assert sorted((r.text, r.page or 0) for r in edits.exclude(rules, new).collect()) == [("t", 0), ("u", 1), ("u", 2)]
    assert [r.text for r in edits.restore(rules, new.filter("text = 't'")).collect()] == ["u"]
    assert {r.text: r.reason for r in edits.reason(rules, new.filter("false").unionByName(rules.filter("text = 't'")), ["doc_id", "text", "page"], "why").collect()} == {"t": "why", "u": "r"}
    kinds = spark.createDataFrame([("d", 1, "t", None, "large", "r")], "doc_id string, page int, text string, at array<double>, kind string, reason string")
    change = spark.createDataFrame([("d", 1, "t", None, "small", "body", "")], "doc_id string, page int, text string, at array<double>, kind string, auto string, reason string")
    assert [r.kind for r in edits.set_kind(kinds, change).collect()] == ["small"]
    merges = spark.createDataFrame([("d", 1, "h", ["a", "b"], "r"), ("d", 2, "h", ["a"], "")], "doc_id string, page int, hit string, add array<string>, reason string")
    moves = spark.createDataFrame([("d", 1, "h", "a", False), ("d", 1, "h", "c", True), ("d", 2, "h", "a", False)], "doc_id string, page int, hit string, text string, add boolean")
    assert [(r.page, r.add, r.reason) for r in edits.merge(merges, moves).collect()] == [(1, ["b", "c"], "r")]
    assert {(r.op, r["count"]) for r in edits.totals({"excluded": rules, "kinds": kinds}).collect()} == {("excluded", 2), ("kinds", 1), (None, 3)}
    assert edits.reset({"kinds": kinds}, "d")["kinds"].count() == 0
    boxes = spark.createDataFrame([("d", 1, 5.0, 5.0, 9.0, 9.0), ("d", 1, 1.0, 7.0, 3.0, 20.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    tables = edits.add_table(spark.createDataFrame([], "doc_id string, page int, rect array<double>, strategy string, reason string"), boxes)
    assert [r.rect for r in tables.collect()] == [[1.0, 5.0, 9.0, 20.0]]


def test_incremental(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, "s"), ("b", 2, "s"), ("c", 1, "s")], "doc_id string, mtime int, sig string")
    built = spark.createDataFrame([("a", 1, "s"), ("b", 1, "s")], "doc_id string, mtime int, sig string")
    path = str(tmp_path / "cache")
    sinks.write_cache(spark.createDataFrame([("a", "kept"), ("b", "old")], "doc_id string, sentence string"), path)
    done = incremental.warm(docs, built, lambda d: d.selectExpr("doc_id", "'new' as sentence"), path)
    assert sorted(r.doc_id for r in done.collect()) == ["b", "c"]
    assert sorted((r.doc_id, r.sentence) for r in spark.read.parquet(path).collect()) == [("a", "kept"), ("b", "new"), ("c", "new")]


def test_stream(spark, tmp_path):
    files.sample_spans(spark).write.parquet(str(tmp_path / "in"))
    query = incremental.follow(spark, str(tmp_path / "in"), files.SPAN, extract.extract, str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 5


def test_sample(spark):
    cells = [[x, y, x2, y + 30] for y in (90.0, 120.0, 150.0) for x, x2 in ((40.0, 200.0), (200.0, 380.0), (380.0, 555.0))]
    table = spark.createDataFrame([("Sample_2024", 3, 0, 40.0, 90.0, 555.0, 180.0, cells)], "doc_id string, page_no int, table_no int, x0 double, y0 double, x1 double, y1 double, cells array<array<double>>")
    from pagelathe.operators.tables import usable

    excluded = spark.createDataFrame([("Sample_2024", "指標。", 3, None, None)], "doc_id string, text string, page int, pt double, at array<double>")
    rows = extract.extract(files.sample_spans(spark), tables=usable(table), rules={"excluded": excluded}).orderBy("ord").collect()
    said = [(r.page_no, r.kind, r.section, r.sentence) for r in rows]
    assert (3, "table", "指標", "LLM研修 百人 八十人。") in said and not any(s[3] == "指標。" for s in said)
    assert (2, "body", "経営の方針", "当社は生成AIを活用し、業務の効率を高めています。") in said
    assert said[0] == (1, "large", "集成報告", "集成報告。")


def test_pages_to_skip(spark):
    lines = spark.createDataFrame([("d", 1, 0, "Cover", 26.0), ("d", 2, 0, "Contents", 20.0), ("d", 2, 1, "one", 9.0), ("d", 3, 0, "Chapter", 18.0), ("d", 4, 0, "SASB Content Index", 12.0), ("d", 4, 1, "x" * 400, 9.0), ("d", 6, 0, "end", 9.0)], "doc_id string, page_no int, ord int, text string, size double")
    every = spark.createDataFrame([("d", p) for p in range(1, 7)], "doc_id string, page_no int")
    got = pages.suggest_skips(every, pages.page_features(lines, spark.createDataFrame([("d", 9.0)], "doc_id string, body double")))
    assert sorted((r.page_no, r.reason) for r in got.collect()) == [(1, "cover"), (2, "contents"), (3, "divider"), (4, "index"), (6, "cover")]
