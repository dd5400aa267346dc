import pytest
from pyspark.sql import functions as F

from pagelathe.functions.text import band, clean, keyword_pattern, page_label, units
from pagelathe.operators import lines as L
from pagelathe.operators import sentences as S
from pagelathe.params import Params


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "min_len", "want"),
    [("売上高", 2, ["売上高。"]), ("一つ目です。二つ目です。", 2, ["一つ目です。", "二つ目です。"]), ("a。long piece。", 4, ["long piece。"]), ("", 2, []), (None, 2, None)],
)
def test_units(spark, text, min_len, want):
    assert one(spark, text, lambda c: units(c, min_len=min_len)) == want


def test_clean_keeps_terminators(spark):
    text = "●見出し\n本文 です。=====\nline one\nline two。"
    got = one(spark, text, clean)
    assert got.count("。") == text.count("。") and "=" not in got and "●" not in got and "line one line two" in got


def test_keyword_boundaries(spark):
    for text, want in (("Fulfillment center", False), ("国産のLLMを使う", True), ("an llm here", True)):
        assert one(spark, text, lambda c: c.rlike(keyword_pattern(["LLM"]))) is want


def test_band(spark):
    b = F.array(*(F.lit(float(x)) for x in (0, 10, 25, 40)))
    got = spark.createDataFrame([(-5.0,), (10.0,), (39.0,), (99.0,)], "v double").select(band(b, F.col("v")).alias("r")).collect()
    assert [r["r"] for r in got] == [0, 1, 2, 2]


def test_page_label(spark):
    rows = spark.createDataFrame([("<0069>-1", 3), (None, 4), ("", 5), ("<1>x", 6)], "v string, n int")
    assert [r["r"] for r in rows.select(page_label(F.col("v"), F.col("n")).alias("r")).collect()] == ["i-1", "4", "5", "<1>x"]


def test_kinds(spark):
    sizes = spark.createDataFrame([(s,) for s in (4.4, 4.5, 8.3, 8.4, 9.6, 9.7)], "s double")
    got = [r["k"] for r in sizes.select(L.kind(F.col("s"), F.lit(9.0), Params()).alias("k")).collect()]
    assert got == ["tiny", "small", "small", "body", "body", "large"]


def test_settings():
    assert Params.of({"repeat_ratio": 0.4, "no_such_key": 1, "table_strategy": "?"}) == Params(repeat_ratio=0.4)


ROWS = [("d", 0, 1, "body", "A", "the LLM here."), ("d", 1, 1, "body", "A", "second one."), ("d", 2, 2, "body", "B", "third one.")]


def test_pages_windows_and_text(spark):
    rows = spark.createDataFrame(ROWS, "doc_id string, ord int, page_no int, kind string, section string, sentence string")
    pages = {r["page_no"]: r for r in S.rollup_pages(rows).collect()}
    assert pages[1]["n_sentences"] == 2 and pages[2]["n_sentences"] == 1 and pages[1]["body"] == "the LLM here.second one."
    w = S.context_windows(rows, keyword_pattern(["LLM"]), 1).collect()
    assert [(r["lo"], r["hi"], r["n_hits"]) for r in w] == [(0, 1, 1)]
    text = [r["line"] for r in S.tagged_text(rows).orderBy("ord", "part").collect()]
    assert text == ["<h1>d</h1>", "<h2>p1</h2>", "the LLM here.", "second one.", "<h2>p2</h2>", "third one."]


@pytest.mark.parametrize(("second", "want"), [(8, [(1, 10)]), (9, [(1, 5), (7, 11)])])
def test_windows_merge(spark, second, want):
    rows = spark.createDataFrame([("d", i, "hit" if i in (3, second) else "x") for i in range(12)], "doc_id string, ord int, sentence string")
    assert sorted((r["lo"], r["hi"]) for r in S.context_windows(rows, "hit", 2).collect()) == want
