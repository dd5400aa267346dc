"""Queries over recorded corrections: the write side of rules, and what is read of saved files, each with its SQL.

Orders stand for rules: the customer is the document, the priority the text; pages, sizes and places are derived from the order's number,
and some of each are open (null). Orders of even numbers are recorded, those of odd numbers are new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.text import page_label, position
from ..operators import edits as E
from ..operators import lines as L
from ..operators import pages as G
from ..operators import tables as T
from ..params import KINDS
from ..sources import files
from .catalogue import _table, blocks, page_lines, query, sentences
from .catalogue import LINES, SENTENCES

RULES = """e as (select o_orderkey as id, o_custkey as doc_id, o_orderpriority as text, case when o_orderkey % 5 = 0 then null else (o_orderkey % 4)::int end as page,
  case when o_orderkey % 7 = 0 then null else (o_orderkey % 3)::double end as pt, case when o_orderkey % 3 = 0 then null else (o_orderkey % 6)::double end as x, o_orderstatus as kind, 'c' || (o_orderkey % 11) as clerk from orders),
r as (select * from e where id % 2 = 0), n as (select * from e where id % 2 = 1)"""
COVERS = "r.doc_id = n.doc_id and r.text = n.text and (r.page is null or n.page is null or r.page = n.page) and (r.pt is null or n.pt is null or r.pt = n.pt) and (r.x is null or n.x is null or abs(r.x - n.x) <= 1)"
PLACE = "doc_id, text, page, pt, x"


def _rules(spark, sf_dir):
    k = F.col("o_orderkey")
    e = _table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("text"), F.when(k % 5 != 0, k % 4).cast("int").alias("page"),
        F.when(k % 7 != 0, k % 3).cast("double").alias("pt"), F.when(k % 3 != 0, F.array((k % 6).cast("double"), F.lit(0.0))).alias("at"), F.col("o_orderstatus").alias("kind"), F.concat(F.lit("c"), (k % 11).cast("string")).alias("clerk"),
    )
    return e.filter("id % 2 = 0"), e.filter("id % 2 = 1")


def _places(rules):
    return rules.select("doc_id", "text", "page", "pt", F.get("at", 0).alias("x"))


@query("r1_exclude", f"with {RULES} select {PLACE} from r union all select {PLACE} from n where not exists (select 1 from r where {COVERS})")
def r1(spark, sf_dir):
    old, new = (t.select("doc_id", "text", "page", "pt", "at") for t in _rules(spark, sf_dir))
    return _places(E.exclude(old, new))


@query("r2_restore", f"with {RULES} select {PLACE} from r where not exists (select 1 from n where {COVERS})")
def r2(spark, sf_dir):
    old, new = (t.select("doc_id", "text", "page", "pt", "at") for t in _rules(spark, sf_dir))
    return _places(E.restore(old, new))


@query("j22_shared_places", f"with {RULES} select {PLACE}, count(*) over (partition by doc_id, text, page, pt) > 1 as shared from r")
def j22(spark, sf_dir):
    out = E.doubles(_rules(spark, sf_dir)[0].select("doc_id", "text", "page", "pt", "at"))
    return out.select("doc_id", "text", "page", "pt", F.get("at", 0).alias("x"), "shared")


@query("r3_joins", f"with {RULES} select doc_id, page, text as a, kind as b from r where page is not null union all select doc_id, page, text, kind from n where page is not null and not exists (select 1 from r where r.doc_id = n.doc_id and r.page = n.page and r.text = n.text and r.kind = n.kind)")
def r3(spark, sf_dir):
    old, new = (t.filter("page is not null").select("doc_id", "page", F.col("text").alias("a"), F.col("kind").alias("b")) for t in _rules(spark, sf_dir))
    return E.join(old, new)


@query("r3_unjoin", f"with {RULES}, b as (select doc_id, page, list(text) || list(kind) as parts from n where page is not null group by 1, 2) select doc_id, page, text as a, kind as b from r where page is not null and not exists (select 1 from b where b.doc_id = r.doc_id and b.page = r.page and list_contains(parts, r.text) and list_contains(parts, r.kind))")
def r3_unjoin(spark, sf_dir):
    old, new = (t.filter("page is not null").select("doc_id", "page", F.col("text").alias("a"), F.col("kind").alias("b")) for t in _rules(spark, sf_dir))
    parts = new.groupBy("doc_id", "page").agg(F.concat(F.collect_list("a"), F.collect_list("b")).alias("parts"))
    return E.unjoin(old, parts)


@query("r4_splits", f"with {RULES} select doc_id, page, text, (id % 5)::int as line from r union all select doc_id, page, text, (id % 5)::int from n where id % 5 >= 1 and id % 5 < 3")
def r4(spark, sf_dir):
    old, new = (t.select("doc_id", "page", "text", (F.col("id") % 5).cast("int").alias("line")) for t in _rules(spark, sf_dir))
    return E.split(old, new.withColumn("n_lines", F.lit(3)))


ONE = "row_number() over (partition by doc_id, text, page order by id) = 1"


@query("r5_kinds", f"""with {RULES}, o as (select * from r qualify {ONE}), m as (select * from n qualify {ONE})
select doc_id, text, page, kind from o where not exists (select 1 from m where m.doc_id = o.doc_id and m.text = o.text and m.page is not distinct from o.page) union all select doc_id, text, page, kind from m where kind <> 'O'""")
def r5(spark, sf_dir):
    first = lambda t: t.groupBy("doc_id", "text", "page").agg(F.min_by("kind", "id").alias("kind")).withColumn("at", F.lit(None).cast("array<double>")).withColumn("reason", F.lit(""))
    old, new = map(first, _rules(spark, sf_dir))
    return E.set_kind(old, new.withColumn("auto", F.lit("O"))).select("doc_id", "text", "page", "kind")


@query("r6_orders", f"""with {RULES}, o as (select doc_id, page, list(text order by id) as keys from r where page is not null group by 1, 2), m as (select doc_id, page, list(text order by id) filter (id % 3 > 0) as keys from n where page is not null group by 1, 2)
select doc_id, page, array_to_string(keys, '|') as keys from o where not exists (select 1 from m where m.doc_id = o.doc_id and m.page = o.page) union all select doc_id, page, array_to_string(keys, '|') from m where len(keys) > 0""")
def r6(spark, sf_dir):
    old, new = (t.filter("page is not null") for t in _rules(spark, sf_dir))
    keys = lambda t, keep: t.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("id", "text")))), lambda x: x["text"]).alias("keys"))
    out = E.order(keys(old, F.lit(True)), keys(new, F.col("id") % 3 > 0))
    return out.select("doc_id", "page", F.array_join("keys", "|").alias("keys"))


@query("r7_drawn_tables", f"with {RULES} select doc_id, page, min(x) as x0, max(x) + 10 as x1, 'text' as strategy from n where page is not null and x is not null group by 1, 2")
def r7(spark, sf_dir):
    old, new = _rules(spark, sf_dir)
    x = F.get("at", 0)
    boxes = new.filter("page is not null and at is not null").select("doc_id", "page", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 10).alias("x1"), F.lit(5.0).alias("y1"))
    none = old.limit(0).select("doc_id", "page", "at", "text").withColumnsRenamed({"at": "rect", "text": "strategy"})
    out = E.add_table(none, boxes)
    return out.select("doc_id", "page", F.get("rect", 0).alias("x0"), F.get("rect", 2).alias("x1"), "strategy")


@query("r7_tables_off", f"with {RULES}, o as (select distinct doc_id, page from r where page is not null), c as (select distinct doc_id, page from n where page is not null) (select * from o except select * from c) union all (select * from c except select * from o)")
def r7_off(spark, sf_dir):
    old, new = (t.filter("page is not null").select("doc_id", "page").distinct() for t in _rules(spark, sf_dir))
    return E.toggle(old, new)


@query("r8_merges", f"""with {RULES}, o as (select doc_id, page, text as hit, clerk as text, min(id) as k from r where page is not null group by 1, 2, 3, 4), c as (select doc_id, page, text as hit, clerk as text, max(id) as id from n where page is not null group by 1, 2, 3, 4),
gone as (select * from o where not exists (select 1 from c where c.id % 3 = 0 and c.doc_id = o.doc_id and c.page = o.page and c.hit = o.hit and c.text = o.text)),
more as (select doc_id, page, hit, text from gone union select doc_id, page, hit, text from c where id % 3 > 0)
select doc_id, page, hit, count(*) as n_texts, min(text) as least from more group by 1, 2, 3""")
def r8(spark, sf_dir):
    old, new = (t.filter("page is not null").select("doc_id", "page", F.col("text").alias("hit"), F.col("clerk").alias("text"), "id") for t in _rules(spark, sf_dir))
    rules = old.groupBy("doc_id", "page", "hit").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"])).alias("add")).withColumn("reason", F.lit("r"))
    changes = new.groupBy("doc_id", "page", "hit", "text").agg((F.max("id") % 3 > 0).alias("add"))
    return E.merge(rules, changes).select("doc_id", "page", "hit", F.size("add").cast("long").alias("n_texts"), F.array_min("add").alias("least"))


@query("r9_replace", f"""with {RULES}, o as (select doc_id, text, max(kind) as reason from r group by 1, 2), m as (select doc_id, text, case when min(id) % 3 = 0 then '' else min(kind) end as reason from n group by 1, 2)
select doc_id, text, reason from o where not exists (select 1 from m where m.doc_id = o.doc_id and m.text = o.text) union all select m.doc_id, m.text, coalesce(nullif(m.reason, ''), o.reason, '') from m left join o using (doc_id, text)""")
def r9(spark, sf_dir):
    old, new = _rules(spark, sf_dir)
    old = old.groupBy("doc_id", "text").agg(F.max("kind").alias("reason"))
    new = new.groupBy("doc_id", "text").agg(F.when(F.min("id") % 3 == 0, "").otherwise(F.min("kind")).alias("reason"))
    return E.replace(old, new, ["doc_id", "text"])


@query("r10_reason", f"with {RULES}, c as (select distinct doc_id, page from n) select r.id, r.doc_id, case when exists (select 1 from c where c.doc_id = r.doc_id and c.page is not distinct from r.page) then 'chosen' else r.kind end as reason from r")
def r10(spark, sf_dir):
    old, new = _rules(spark, sf_dir)
    return E.reason(old.withColumnRenamed("kind", "reason"), new, ["doc_id", "page"], "chosen").select("id", "doc_id", "reason")


@query("r12_reset", f"with {RULES} select 'excluded' as op, id from r where doc_id <> 7 union all select 'unit_checks', id from n")
def r12(spark, sf_dir):
    old, new = _rules(spark, sf_dir)
    left = E.reset({"excluded": old, "unit_checks": new}, 7)
    return reduce(lambda a, b: a.unionByName(b), (t.select(F.lit(op).alias("op"), "id") for op, t in left.items()))


@query("r13_remove", f"with {RULES} select id from r where not exists (select 1 from n where n.doc_id = r.doc_id and n.page is not distinct from r.page and n.text = r.text)")
def r13(spark, sf_dir):
    old, new = _rules(spark, sf_dir)
    return E.remove(old, new, ["doc_id", "page", "text"]).select("id")


@query("a24_totals", f"with {RULES}, t as (select doc_id, 'excluded' as op from r union all select doc_id, 'joins' from n) select doc_id, op, count(*) as \"count\" from t group by grouping sets ((doc_id, op), (doc_id))")
def a24(spark, sf_dir):
    old, new = _rules(spark, sf_dir)
    return E.totals({"excluded": old, "joins": new})


# Spans, places, labels, texts with marks


SPANS = """sp as (select source as doc_id, doc_id as page_no, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_ord from documents),
parts as (select *, [substr(line, 1, 7), substr(line, 8, 9), substr(line, 17)] as p from sp),
each as (select doc_id, page_no, line_ord, unnest(p) as text, generate_subscripts(p, 1) - 1 as span_ord from parts),
sized as (select *, 8.0 + span_ord as size, length(trim(text)) as n from each)"""


def _spans(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.posexplode(F.split("text", "\n")).alias("line_ord", "line"))
    cuts = F.array(F.substring("line", 1, 7), F.substring("line", 8, 9), F.expr("substring(line, 17)"))
    out = docs.select("doc_id", "page_no", F.lit(0).alias("block_ord"), "line_ord", F.posexplode(cuts).alias("span_ord", "text"))
    box = {c: F.lit(0.0) for c in ("x0", "y0", "x1", "y1")}
    return out.withColumns(box | {"size": F.lit(8.0) + F.col("span_ord"), "flags": F.when(F.col("span_ord") == 1, 16).otherwise(0), "font": F.lit("Plain")})


@query("p1_lines_from_spans", f"""with {SPANS}, big as (select doc_id, page_no, line_ord, size from sized where n > 0 qualify row_number() over (partition by doc_id, page_no, line_ord order by n desc, span_ord) = 1),
g as (select doc_id, page_no, line_ord, string_agg(text, '' order by span_ord) as text, sum(n) filter (span_ord = 1)::double / sum(n) >= 0.8 as bold from sized group by 1, 2, 3 having sum(n) > 0)
select doc_id, page_no, g.text, row_number() over (partition by doc_id, page_no order by line_ord) - 1 as ord, size::double as size, bold from g join big using (doc_id, page_no, line_ord)""")
def p1(spark, sf_dir):
    """Lines of three spans each, of which the second is bold and the last often blank: text, size of the longest, boldness."""
    return L.collect_lines(_spans(spark, sf_dir)).select("doc_id", "page_no", "text", "ord", "size", "bold")


MARKS = ["●", "■", "▲", "◆", "•", "⚫", "▶", "◦", "○", "※1 ", "・", "1．", "1、", "12.", "123) ", "A) ", "b. ", "(12)", "（3）", "①", "-", "△", "２．", ""]
SQL_MARKS = "[" + ", ".join(f"'{m}'" for m in MARKS) + "]"


def _marked(spark, sf_dir):
    at = F.pmod(F.col("c_custkey"), F.lit(len(MARKS))) + 1
    return _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.element_at(F.array(*map(F.lit, MARKS)), at.cast("int")), "c_name").alias("text"))


@query("p8_list_heads", rf"""select c_custkey, m || c_name as text, regexp_matches(m || c_name, '^([●○■□◆◇▲△▼▽・※]|[①-⑳]|[（(][0-9０-９]{{1,2}}[)）]|[0-9０-９]{{1,2}}[．.、]\s*\S|[a-zA-Z][.)]\s)') as head
from (select *, {SQL_MARKS}[c_custkey % {len(MARKS)} + 1] as m from customer)""")
def p8(spark, sf_dir):
    from ..functions.text import LIST_HEAD

    return _marked(spark, sf_dir).withColumn("head", F.col("text").rlike(LIST_HEAD))


@query("f1_clean_marks", f"select c_custkey, regexp_replace(m || c_name, '[■●▲◆•⚫]', '', 'g') as cleaned from (select *, {SQL_MARKS}[c_custkey % {len(MARKS)} + 1] as m from customer)")
def f1_marks(spark, sf_dir):
    from ..functions.text import clean

    return _marked(spark, sf_dir).select("c_custkey", clean(F.col("text")).alias("cleaned"))


@query("p15_keywords", r"""with t as (select c_custkey, ['C++ 17', 'C++17', 'xC++', 'LLM', 'Fulfillment', 'the LLMs', '国産のLLMを', 'Gen-AI x', 'aGen-AI'][c_custkey % 9 + 1] as text from customer)
select c_custkey, text, regexp_matches(text, '(?i)(C\+\+|(^|[^A-Za-z])LLM([^A-Za-z]|$)|(^|[^A-Za-z])Gen-AI([^A-Za-z]|$))') as hit from t""")
def p15(spark, sf_dir):
    from ..functions.text import keyword_pattern

    texts = ["C++ 17", "C++17", "xC++", "LLM", "Fulfillment", "the LLMs", "国産のLLMを", "Gen-AI x", "aGen-AI"]
    t = _table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, texts)), (F.col("c_custkey") % 9 + 1).cast("int")).alias("text"))
    return t.withColumn("hit", F.col("text").rlike(keyword_pattern(["C++", " ", "LLM", "Gen-AI"])))


@query("p12_positions", "select o_orderkey, case when o_orderkey % 4 in (0, 1) then null else round_even(floor(o_totalprice) / 7.0::double, 1)::double end as x from orders")
def p12(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    x = (F.floor("o_totalprice") / F.lit(7.0)).cast("string")
    at = F.when(k == 0, F.array(F.lit("a"), x)).when(k == 1, F.array(x)).otherwise(F.array(x, F.lit("2")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.get(position(at), 0).alias("x"))


@query("p3_page_labels", "select c_custkey, case c_custkey % 4 when 0 then 'i-' || c_custkey when 1 then c_custkey::varchar when 2 then 'p ' || c_custkey else c_custkey::varchar end as label from customer")
def p3(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    raw = F.element_at(F.array(F.concat(F.lit("<FEFF0069>-"), key), F.lit(None).cast("string"), F.concat(F.lit(" p "), key), F.lit("  ")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select("c_custkey", page_label(raw, F.col("c_custkey")).alias("label"))


@query("a19_export_breakdown", f"""with {SENTENCES} select doc_id, count(*) filter (kind = 'body') as body, count(*) filter (kind = 'large') as large, 0::bigint as small, 0::bigint as tiny, count(*) filter (kind = 'table') as "table",
count(*) as total, sum(length(sentence))::bigint as n_chars from s group by doc_id""")
def a19(spark, sf_dir):
    return G.export_breakdown(sentences(spark, sf_dir, False))


@query("j20_page_summary", f"""with {LINES}, p as (select doc_id, page_no, count(*) filter (kind = 'body') as body, count(*) filter (kind = 'large') as large, count(*) as total, coalesce(arg_min(text, ord) filter (kind = 'large'), '') as section from l group by 1, 2)
select d.source as doc_id, d.doc_id as page_no, coalesce(body, 0) as body, coalesce(large, 0) as large, 0::bigint as small, 0::bigint as tiny, 0::bigint as "table", coalesce(total, 0) as total, coalesce(section, '') as section,
case when d.doc_id % 3 = 0 then 1 else 0 end::bigint as n_tables, case when d.doc_id % 10 = 0 then 'cover' else '' end as reason, case when d.doc_id % 10 = 0 then 'w' else '' end as why from documents d left join p on p.doc_id = d.source and p.page_no = d.doc_id""")
def j20(spark, sf_dir):
    pages = _table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"))
    b = blocks(spark, sf_dir).withColumn("units", F.array(F.struct(F.col("raw").alias("text"), F.lit(False).alias("excluded")))).withColumn("is_section", F.col("kind") == "large")
    skips = pages.filter("page_no % 10 = 0").withColumn("reason", F.lit("cover")).withColumn("why", F.lit("w"))
    out = G.page_summary(pages, b, pages.filter("page_no % 3 = 0"), skips)
    return out.select("doc_id", "page_no", *KINDS, "total", "section", "n_tables", "reason", "why")


@query("t3_tables_found", """with d as (select doc_id as page_no from documents) select page_no, 0 as table_no, false as manual from d where page_no % 2 = 0 and page_no % 7 <> 0 union all
select page_no, 0, false from d where page_no % 2 = 1 and page_no % 7 <> 0 union all select page_no, 0, true from d where page_no % 7 = 0 and page_no % 5 = 0 union all select page_no, 1, true from d where page_no % 7 <> 0 and page_no % 5 = 0""")
def t3(spark, sf_dir):
    """Strict tables on even pages, a fallback on all, none on every seventh, one drawn by hand on every fifth."""
    pages = _table(spark, sf_dir, "documents").select(F.lit(1).alias("doc_id"), F.col("doc_id").alias("page_no"))
    grid = lambda x: F.array(*(F.array(*map(F.lit, (x + a, b, x + a + 10.0, b + 10.0))) for a in (0.0, 10.0) for b in (0.0, 10.0)))
    at = lambda t, x: t.select("*", F.lit(0).alias("table_no"), F.lit(x).alias("x0"), F.lit(0.0).alias("y0"), F.lit(x + 20.0).alias("x1"), F.lit(20.0).alias("y1"), grid(x).alias("cells"))
    out = T.detected(at(pages.filter("page_no % 2 = 0"), 0.0), at(pages, 100.0), at(pages.filter("page_no % 5 = 0"), 300.0), pages.filter("page_no % 7 = 0"))
    return out.select("page_no", "table_no", "manual")


@query("s6_settings", "select event_id, case when event_id % 3 = 0 then null else 0.4::double end as repeat_ratio, case when event_id % 2 = 0 then 2 else 1 end::int as n_skips from events")
def s6(spark, sf_dir):
    """Settings as saved by three ages of the engine: pages to skip as numbers, as objects, with unknown keys."""
    ratio = F.when(F.col("event_id") % 3 == 0, '"old_key": 1').otherwise('"repeat_ratio": 0.4')
    skips = F.when(F.col("event_id") % 2 == 0, '[3, {"page": 5, "reason": "cover"}]').otherwise('[{"page": 2}, {"reason": "x"}]')
    texts = _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("{"), ratio, F.lit(', "skip_pages": '), skips, F.lit("}")).alias("json"))
    out = files.parse_settings(texts)
    return out.select("event_id", "settings.repeat_ratio", F.size("settings.skip_pages").alias("n_skips"))


@query("s11_uploads", """select c_custkey, case when c_custkey % 5 = 0 then 'no company' when c_custkey % 5 = 1 then 'year is not four digits' when c_custkey % 5 = 2 then 'forbidden character' when c_custkey % 5 = 3 then 'no PDF' when c_custkey % 2 = 0 then 'exists' end as error from customer""")
def s11(spark, sf_dir):
    k = F.col("c_custkey")
    new = _table(spark, sf_dir, "customer").select(k, F.when(k % 5 == 0, " ").when(k % 5 == 2, F.lit("a/b")).otherwise(F.concat(F.lit("co"), k.cast("string"))).alias("company"), F.when(k % 5 == 1, "24").otherwise("2024").alias("year"), F.when(k % 5 == 3, F.lit("GIF8").cast("binary")).otherwise(F.lit("%PDF").cast("binary")).alias("head"))
    present = new.filter("c_custkey % 2 = 0 and c_custkey % 5 = 4").select(F.concat_ws("_", "company", "year").alias("doc_id"))
    return files.check_uploads(new, present).select("c_custkey", "error")


@query("f8_names", "select c_custkey, case when c_custkey % 2 = 0 then c_name else c_name || '_x' end as company, case when c_custkey % 2 = 0 then (2000 + c_custkey % 30)::varchar else '' end as year from customer")
def f8(spark, sf_dir):
    stem = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("_"), (2000 + F.col("c_custkey") % 30).cast("string"))).otherwise(F.concat("c_name", F.lit("_x")))
    return _table(spark, sf_dir, "customer").select("c_custkey", *files.parse_name(stem))
