"""Lines of spans against plain loops; the plan that puts them together; the count of kana and kanji."""

import random

from pyspark.sql import functions as F

from pagelathe.functions.text import BLANK, japanese_chars
from pagelathe.operators import lines as L

SPAN = "doc_id string, page_no int, block_ord int, line_ord int, span_ord int, text string, x0 double, y0 double, x1 double, y1 double, size double, flags int, font string"
KANA = ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))


def japanese(text):
    return sum(any(a <= ord(c) <= b for a, b in KANA) for c in text)


def spans():
    rnd, rows = random.Random(9), []
    texts = ["", " ", "　", "a", " bc ", "über", "漢字 ", "かなx", "longer text", None]
    for doc in ("d", "e", None):
        for page in (1, 2, None):
            for block in range(3):
                for line in range(4):
                    many = 600 if (doc, page, block, line) == ("e", 2, 1, 1) else rnd.randint(1, 5)
                    for k in range(many):
                        rows.append((doc, page, block, line, k, rnd.choice(texts), float(k), 0.0, 1.0, 9.0, rnd.choice([9.0, 9.04, 12.5, 14.0]), rnd.choice([0, 16, None]), rnd.choice(["Plain", "X-Bold", None])))
    rnd.shuffle(rows)
    return rows


def test_lines_against_loops(spark):
    rows = spans()
    by_line = {}
    for r in rows:
        by_line.setdefault(r[:4], []).append(r)
    want, number = [], {}
    for key in sorted(by_line, key=lambda k: (str(k[0]), str(k[1]), k[2], k[3])):
        parts = sorted(by_line[key], key=lambda r: r[4])
        told = [(len(r[5].strip(BLANK)), japanese(r[5]), r) for r in parts if r[5] is not None]
        if not any(n for n, _, _ in told):
            continue
        size = max((j > 0, j or n, -r[4], round(r[10], 1)) for n, j, r in told if n)[3]
        heavy = sum(n for n, _, r in told if (r[11] or 0) & 16 or "bold" in (r[12] or "").lower())
        ord_ = number[key[:2]] = number.get(key[:2], -1) + 1
        want.append((*key, "".join(r[5] for _, _, r in told), parts[0][6], size, heavy / sum(n for n, _, _ in told) >= 0.8, ord_))
    got = L.collect_lines(spark.createDataFrame(rows, SPAN)).select("doc_id", "page_no", "block_ord", "line_ord", "text", "x0", "size", "bold", "ord").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_spans_are_shuffled_once(spark):
    """By page, with no grouping of lists; characters are counted once a span."""
    plan = L.collect_lines(spark.createDataFrame(spans()[:50], SPAN))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and plan.count("regexp_replace") == 1 and plan.count("trim(") == 1, plan


def test_japanese_chars(spark):
    """Each character of the basic plane alone, and texts that mix them; the pattern looks for what is counted, not for all else."""
    codes = spark.range(1, 0xD800).unionByName(spark.range(0xE000, 0x10000)).select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    got = codes.select("id", japanese_chars(F.col("c")).alias("n"), japanese_chars(F.concat(F.lit("aü"), "c", F.lit("漢 "), "c")).alias("m")).collect()
    assert all(r.n == japanese(chr(r.id)) and r.m == 2 * r.n + 1 for r in got)
    few = spark.createDataFrame([(None,), ("",), ("𠮷漢😀",)], "t string").select("t", japanese_chars(F.col("t")).alias("n"))
    assert {r.t: r.n for r in few.collect()} == {None: None, "": 0, "𠮷漢😀": 1}
    assert "[^" not in few._jdf.queryExecution().executedPlan().toString()
