"""Rules whose text recurs over a document meet only their own page's rows; white space at the ends of texts."""

import random

import pytest
from pyspark.sql import functions as F

from pagelathe.functions.text import BLANK, strip
from pagelathe.operators import rules as R

RULE = "doc_id string, text string, page int, pt double, at array<double>, kind string, rule_ord int"


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("de"), p, i, rnd.choice(["a", " a", "b ", "c"]), float(rnd.randint(0, 3)), float(rnd.randint(0, 3)), rnd.choice([9.0, 9.04, 14.0]), "body") for p in range(30) for i in range(6)]
    rules = [(rnd.choice("de"), rnd.choice(["a", "b", "b ", "", None]), rnd.choice([None, rnd.randrange(30)]), rnd.choice([None, 9.0, 14.0]), rnd.choice([None, [0.0, 2.5], [2.0, None]]), rnd.choice(["tiny", "small", "odd"]), i) for i in range(60)]
    return rows, rules, spark.createDataFrame(rows, "doc_id string, page_no int, ord int, raw string, x0 double, y0 double, size double, kind string"), spark.createDataFrame(rules, RULE)


def fits(rule, row, exact=False):
    doc, text, page, pt, at = rule[:5]
    same = text is not None and text.strip() and (text == row[3] if exact else text.strip() == row[3].strip())
    near = at is None or None not in at and abs(at[0] - row[4]) <= 1 and abs(at[1] - row[5]) <= 1
    return bool(same) and doc == row[0] and page in (None, row[1]) and near and (pt is None or abs(pt - row[6]) <= 0.05)


def test_rules_against_loops(tables):
    rows, rules, lines, r = tables
    key = lambda x: tuple(x[:3])
    assert sorted(map(key, R.excluded(lines, r, "raw").collect())) == sorted(key(x) for x in rows if any(fits(q, x) for q in rules))
    assert sorted(x.rule_ord for x in R.unused(lines, r, "raw").collect()) == [q[6] for q in rules if q[2] is not None and q[1] and q[1].strip() and not any(fits(q, x) for x in rows)]
    bare = r.drop("pt")
    no_pt = [(*q[:3], None, *q[4:]) for q in rules]
    assert sorted(x.rule_ord for x in R.unused(lines, bare, "raw").collect()) == [q[6] for q in no_pt if q[2] is not None and q[1] and q[1].strip() and not any(fits(q, x) for x in rows)]
    for table, told in ((r, rules), (bare, no_pt)):
        want = []
        for x in rows:
            met = sorted((q for q in told if q[5] != "odd" and fits(q, x, True)), key=lambda q: (q[2] is None, q[6]))
            want.append((*key(x), met[0][5] if met else x[7], met[0][5] if met else None))
        got = R.override_kinds(lines, table, ["doc_id", "page_no", "ord"], "forced").select("doc_id", "page_no", "ord", "kind", "forced")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_rules_for_a_page_are_joined_by_page(spark, tables):
    """A text on every page, with a rule a page: joined by text alone, each row would meet the rules of all pages."""
    _, _, lines, rules = tables
    for df in (R.excluded(lines, rules, "raw"), R.unused(lines, rules, "raw")):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        joins = [x for x in plan.splitlines() if "Join" in x and ", Left" in x]
        assert joins and any("page" in x for x in joins) and not any("isnull(r_page" in x for x in joins), plan
    lines = spark.range(400).select(F.lit("d").alias("doc_id"), F.col("id").alias("page_no"), F.lit("t").alias("text"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("size"))
    rules = spark.range(400).select(F.lit("d").alias("doc_id"), F.lit("t").alias("text"), F.lit(None).cast("long").alias("page"), F.lit(9.0).alias("pt"), F.lit(None).cast("array<double>").alias("at"))
    met = R._met(lines, rules, "text")
    assert met.select(F.max(F.size("_any"))).first()[0] == 1 and met.count() == 400  # 400 equal rules for any page are one


def test_strip(spark):
    """As the pattern it replaces, for every character of the basic plane."""
    codes = spark.range(1, 0xD800).unionByName(spark.range(0xE000, 0x10000)).select(F.col("id"), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    old = F.regexp_replace("t", r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    texts = codes.select("c", F.explode(F.array("c", F.concat("c", F.lit("x y"), "c"), F.concat(F.lit(" "), "c", F.lit("z"), "c", F.lit("\n")))).alias("t"))
    assert texts.filter(strip(F.col("t")) != old).count() == 0
    assert codes.filter(strip(F.col("c")) == "").count() == len(BLANK)
