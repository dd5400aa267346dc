"""The engine's operators as queries over the driver's tables, each with its SQL.

A source stands for a document, a doc_id for a page of it, pieces between newlines for lines. Layout is derived: line k of a page lies at
y0 = 12 k; every fifth line at x0 = 300, others at 0; lines of 40 characters at most have size 14, others 9 (the body size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, keyword_pattern, units
from ..operators import folds
from ..operators import lines as L
from ..operators import pages as G
from ..operators import rules as R
from ..operators import sentences as S
from ..operators import tables as T
from ..params import KINDS, Params
from ..sources import files, sinks
from . import extract as X

P = Params(terminator=".", repeat_ratio=0.1)
#: Of up to so many pages, the numbers of their first sentences are sent to all executors (about 60 bytes each).
SENT_PAGES = 4_000_000
WORDS = ["the", "token", "license"]
SQL_WORDS = r"(?i)(^|[^A-Za-z])(the|token|license)([^A-Za-z]|$)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over at least as many tasks as there are cores: a table of one split would be cleaned by one task."""
    docs, n = _table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(n, "doc_id") if docs.rdd.getNumPartitions() < n else docs


def sentences(spark, sf_dir, in_document: bool = True) -> DataFrame:
    """L1 rows: doc_id, page_no, k (in the page), ord (in the document, or else in the page), sentence, kind, section, block_id."""
    docs = _documents(spark, sf_dir)
    named = [F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no")]
    if in_document:
        pages = docs.select(F.monotonically_increasing_id().alias("row"), *named, units(F.col("text"), ".", 2).alias("units"))
        pages = X.cut(pages.withColumn("n", F.size("units")))  # cleaned once, whatever reads it how often
        before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
        start = X.cut(pages.select("row", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))  # a number a page
        few = start.count() <= SENT_PAGES  # then no reader shuffles the texts
        out = pages.join(F.broadcast(start) if few else start, "row").select("doc_id", "page_no", "start", F.posexplode("units").alias("k", "sentence"))
        out = out.withColumn("ord", (F.col("start") + F.col("k")).cast("int")).drop("start")
    else:  # the generator holds the cleaning itself, so that no inferred filter repeats it
        out = docs.select(*named, F.posexplode(units(F.col("text"), ".", 2)).alias("k", "sentence")).withColumn("ord", F.col("k"))
    kind = F.when(F.col("k") % 7 == 3, "table").when(F.length("sentence") <= 20, "large").otherwise("body")
    return out.withColumn("kind", kind).withColumn("section", F.concat(F.lit("s"), (F.col("k") % 3).cast("string"))).withColumn("block_id", F.col("page_no") * 1000 + F.floor(F.col("k") / 7))


def page_lines(spark, sf_dir) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    out = out.withColumn("text", F.trim("text")).filter("text <> ''")
    return out.withColumn("x0", F.when(F.col("ord") % 5 == 4, 300.0).otherwise(0.0)).withColumn("y0", F.col("ord") * F.lit(12.0)).withColumn("size", F.when(F.length("text") <= 40, 14.0).otherwise(9.0)).withColumn("bold", F.lit(False))


def blocks(spark, sf_dir) -> DataFrame:
    """Each line as a block of its own."""
    out = page_lines(spark, sf_dir).withColumnRenamed("text", "raw")
    return out.withColumn("kind", L.kind(F.col("size"), F.lit(9.0), P))


def _pages(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("n_pages"))


# The same bases in SQL.
RUNS = "|".join(rf"\{c}{{3,}}" for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~")
NEWLINE = "([A-Za-z0-9])\\n([A-Za-z0-9])"
SQL_CLEAN = "replace(text, '　', ' ')"
SQL_CLEAN = rf"regexp_replace({SQL_CLEAN}, '[ \t]+', ' ', 'g')"
SQL_CLEAN = f"regexp_replace({SQL_CLEAN}, '[■●▲◆•⚫]', '', 'g')"
SQL_CLEAN = rf"regexp_replace({SQL_CLEAN}, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')"
SQL_CLEAN = rf"regexp_replace(regexp_replace({SQL_CLEAN}, '{NEWLINE}', '\1 \2', 'g'), '{NEWLINE}', '\1 \2', 'g')"
SQL_CLEAN = f"regexp_replace(replace({SQL_CLEAN}, chr(10), ''), '{RUNS.replace(chr(39), chr(39) * 2)}', '', 'g')"
SENTENCES = rf"""
raw as (select source, doc_id, list_filter(list_transform(string_split({SQL_CLEAN}, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 2) as u from documents),
pieces as (select source, doc_id, unnest(u) as x, generate_subscripts(u, 1) - 1 as k from raw),
s as (select source as doc_id, doc_id as page_no, k, x || '.' as sentence, row_number() over (partition by source order by doc_id, k) - 1 as ord,
      case when k % 7 = 3 then 'table' when length(x) + 1 <= 20 then 'large' else 'body' end as kind, 's' || (k % 3) as section, doc_id * 1000 + k // 7 as block_id from pieces),
pages_of as (select source as doc_id, count(*) as n_pages from documents group by 1)"""
LINES = """
cut as (select source, doc_id, string_split(text, chr(10)) as u from documents),
each as (select source as doc_id, doc_id as page_no, generate_subscripts(u, 1) - 1 as ord, trim(unnest(u), ' ') as text from cut),
l as (select *, case when ord % 5 = 4 then 300.0 else 0.0 end::double as x0, (ord * 12)::double as y0, case when length(text) <= 40 then 14.0 else 9.0 end::double as size,
      case when length(text) <= 40 then 'large' else 'body' end as kind from each where text <> '')"""
HIT = f"regexp_matches(sentence, '{SQL_WORDS}')"

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


RATE = "n_sentences, n_hit_sentences, n_pages, n_hit_pages, coalesce(round(n_hit_sentences * 100.0::double / nullif(n_sentences, 0), 3), 0) as sentence_rate_pct, coalesce(round(n_hit_pages * 100.0::double / nullif(n_pages, 0), 2), 0) as page_rate_pct"
BY = f"by_doc as (select doc_id, count(*) as n_sentences, count(*) filter ({HIT}) as n_hit_sentences, any_value(n_pages) as n_pages, count(distinct page_no) filter ({HIT}) as n_hit_pages from s join pages_of using (doc_id) group by 1)"


@query("a7_sentence_rates", f"with {SENTENCES}, {BY} select doc_id, {RATE} from by_doc")
def a7(spark, sf_dir):
    return S.rates(sentences(spark, sf_dir, False), _pages(spark, sf_dir), keyword_pattern(WORDS))


@query("a8_rates_total", f"with {SENTENCES}, {BY}, t as (select doc_id, sum(n_sentences)::bigint as n_sentences, sum(n_hit_sentences)::bigint as n_hit_sentences, sum(n_pages)::bigint as n_pages, sum(n_hit_pages)::bigint as n_hit_pages from by_doc group by grouping sets ((doc_id), ())) select doc_id, {RATE} from t")
def a8(spark, sf_dir):
    return S.rates(sentences(spark, sf_dir, False), _pages(spark, sf_dir), keyword_pattern(WORDS), total=True)


@query("f2_sentences", f"with {SENTENCES} select doc_id, page_no, k, ord, sentence from s")
def f2(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "page_no", "k", "ord", "sentence")


@query("f1_clean_text", f"select doc_id, {SQL_CLEAN} as cleaned from documents")
def f1(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", clean(F.col("text")).alias("cleaned"))


@query("a4_page_rollup", f"""with {SENTENCES}, c as (select doc_id, page_no, kind, count(*) as n, min(ord) as o from s group by all),
m as (select doc_id, page_no, kind from c qualify row_number() over (partition by doc_id, page_no order by n desc, o) = 1)
select doc_id, page_no, any_value(m.kind) as kind, arg_min(section, ord) as section, count(*) as n_sentences, sum(length(sentence))::bigint as n_chars, string_agg(sentence, '' order by ord) as body
from s join m using (doc_id, page_no) group by doc_id, page_no""")
def a4(spark, sf_dir):
    return S.rollup_pages(sentences(spark, sf_dir, False))


@query("w7_context_windows", f"""with {SENTENCES}, h as (select doc_id, ord, ord - lag(ord) over (partition by doc_id order by ord) as d from s where {HIT}),
g as (select doc_id, ord, sum(case when d <= 5 then 0 else 1 end) over (partition by doc_id order by ord) as window_id from h), e as (select doc_id, max(ord) as last_ord from s group by 1)
select doc_id, window_id::bigint as window_id, greatest(min(ord) - 2, 0) as lo, least(max(ord) + 2, any_value(last_ord)) as hi, count(*) as n_hits from g join e using (doc_id) group by doc_id, window_id""")
def w7(spark, sf_dir):
    return S.context_windows(sentences(spark, sf_dir), keyword_pattern(WORDS), 2)


@query("j16_window_sentences", f"""with {SENTENCES}, h as (select doc_id, ord, ord - lag(ord) over (partition by doc_id order by ord) as d from s where regexp_matches(sentence, '(?i)(^|[^A-Za-z])(the|token|license)([^A-Za-z]|$)')),
g as (select doc_id, ord, sum(case when d <= 5 then 0 else 1 end) over (partition by doc_id order by ord) as window_id from h),
w as (select doc_id, window_id, min(ord) - 2 as lo, max(ord) + 2 as hi from g group by 1, 2)
select s.doc_id, window_id::bigint as window_id, s.ord, s.page_no, s.sentence from w join s on s.doc_id = w.doc_id and s.ord between lo and hi""")
def j16(spark, sf_dir):
    rows = sentences(spark, sf_dir)
    return S.window_rows(S.context_windows(rows, keyword_pattern(WORDS), 2), rows).select("doc_id", "window_id", "ord", "page_no", "sentence")


UNITS = f"""hits as (select * from s where {HIT}), t as (select doc_id, block_id, min(ord) as anchor, count(*) as n_hits from hits where kind = 'table' group by 1, 2),
b as (select doc_id, block_id, count(*) as n_sentences, sum(length(sentence))::bigint as n_chars from s group by 1, 2),
u0 as (select doc_id, anchor, n_hits, n_sentences, n_chars from t join b using (doc_id, block_id) union all select doc_id, ord, 1, 1, length(sentence) from hits where kind <> 'table'),
u as (select u0.doc_id, u0.anchor, u0.n_hits, u0.n_sentences, u0.n_chars, page_no, kind, section, sentence, case kind when 'table' then 'row' when 'large' then 'heading' else 'sentence' end as rule, row_number() over (partition by u0.doc_id order by u0.anchor) as unit_id
      from u0 join s on s.doc_id = u0.doc_id and s.ord = u0.anchor)"""
COLUMNS = ["doc_id", "unit_id", "anchor", "page_no", "kind", "section", "rule", "n_hits", "n_sentences", "n_chars", "sentence", "adopted", "reason"]


@query("c8_units", f"with {SENTENCES}, {UNITS} select doc_id, unit_id, anchor, page_no, kind, section, rule, n_hits, n_sentences, n_chars, sentence, true as adopted, '' as reason from u")
def c8(spark, sf_dir):
    return S.units(sentences(spark, sf_dir), keyword_pattern(WORDS)).select(*COLUMNS)


def _excludes(rows):
    """A recorded exclusion for every tenth sentence, twice for some: the later rule's reason stands."""
    r = rows.filter("ord % 10 = 0").select("doc_id", F.col("page_no").alias("page"), F.col("sentence").alias("text"), F.lit("boilerplate").alias("reason"), F.lit(1).alias("rule_ord"))
    return r.unionByName(r.filter("page % 2 = 0").withColumn("reason", F.lit("")).withColumn("rule_ord", F.lit(2)))


@query("j14_units_with_excludes", f"""with {SENTENCES}, {UNITS}, x as (select distinct doc_id, page_no, sentence from s where ord % 10 = 0)
select u.doc_id, unit_id, anchor, u.page_no, kind, section, rule, n_hits, n_sentences, n_chars, u.sentence, x.doc_id is null as adopted, case when x.doc_id is null or u.page_no % 2 = 0 then '' else 'boilerplate' end as reason
from u left join x on x.doc_id = u.doc_id and x.page_no = u.page_no and x.sentence = u.sentence""")
def j14(spark, sf_dir):
    rows = sentences(spark, sf_dir)
    return S.units(rows, keyword_pattern(WORDS), _excludes(rows)).select(*COLUMNS)


@query("j17_near_context", f"""with {SENTENCES}, {UNITS}, d as (select unnest([-2, -1, 1, 2]) as side)
select u.doc_id, unit_id, side, s.sentence as near from u cross join d join s on s.doc_id = u.doc_id and s.ord = anchor + side""")
def j17(spark, sf_dir):
    rows = sentences(spark, sf_dir)
    return S.near_context(S.units(rows, keyword_pattern(WORDS)), rows, 2)


@query("j15_nearest_row", f"""with {SENTENCES}, w as (select distinct doc_id, ord + 3 as anchor, sentence as text from s)
select w.doc_id, anchor, text, s.ord from w join s on s.doc_id = w.doc_id and s.sentence = text and s.ord between anchor - 40 and anchor + 40 qualify row_number() over (partition by w.doc_id, anchor, text order by abs(s.ord - anchor), s.ord) = 1""")
def j15(spark, sf_dir):
    rows = sentences(spark, sf_dir)
    wanted = rows.select("doc_id", (F.col("ord") + 3).alias("anchor"), F.col("sentence").alias("text"))
    return S.nearest_rows(wanted, rows)


@query("k5_tagged_text", f"""with {SENTENCES}, p as (select *, lag(page_no) over (partition by doc_id order by ord) as was from s)
select doc_id, ord, 0 as part, '<h1>' || doc_id || '</h1>' as line from p where was is null union all
select doc_id, ord, 1, '<h2>p' || page_no || '</h2>' from p where was is null or was <> page_no union all select doc_id, ord, 2, sentence from p""")
def k5(spark, sf_dir):
    return S.tagged_text(sentences(spark, sf_dir))


@query("k9_split_export_counts", f"with {SENTENCES}, {UNITS} select doc_id, rule as label, count(*) as n from u group by 1, 2")
def k9(spark, sf_dir):
    out = S.units(sentences(spark, sf_dir), keyword_pattern(WORDS)).filter("adopted")
    return sinks.split_rows(out.withColumn("adopted", F.lit("○")), "rule").groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@query("a1_size_histogram_top", f"""with {LINES}, h as (select doc_id, size, sum(length(text))::bigint as chars from l group by 1, 2)
select doc_id, size, chars, round_even(chars * 100.0::double / sum(chars) over (partition by doc_id), 1) as share from h""")
def a1(spark, sf_dir):
    return L.size_histogram(page_lines(spark, sf_dir)).select("doc_id", "size", "chars", "share")


@query("a2_body_size", f"""with {LINES}, h as (select doc_id, size, sum(length(text)) as chars, min(page_no * 100000 + ord) as o from l group by 1, 2)
select doc_id, size as body from h qualify row_number() over (partition by doc_id order by chars desc, o) = 1""")
def a2(spark, sf_dir):
    return L.body_size(L.size_histogram(page_lines(spark, sf_dir)))


RUNNING = """r as (select doc_id, text, round_even(x0 / 3, 0)::double as bucket, count(distinct page_no) as pages from l group by 1, 2, 3),
run as (select r.* from r join (select source as doc_id, count(*) as n from documents group by 1) using (doc_id) where pages >= greatest(5, floor(n * 0.1::double + 0.999)))"""


@query("a3_running_lines", f"with {LINES}, {RUNNING} select doc_id, text, bucket, pages from run")
def a3(spark, sf_dir):
    return L.running_lines(page_lines(spark, sf_dir), P, _pages(spark, sf_dir))


@query("p5_lines_without_running", f"with {LINES}, {RUNNING} select doc_id, page_no, ord, text from l where not exists (select 1 from run where run.doc_id = l.doc_id and run.text = l.text and bucket = round_even(x0 / 3, 0))")
def p5(spark, sf_dir):
    rows = page_lines(spark, sf_dir)
    return L.without_running(rows, L.running_lines(rows, P, _pages(spark, sf_dir))).select("doc_id", "page_no", "ord", "text")


HEADS = r"^([●○■□◆◇▲△▼▽・※]|[①-⑳]|[（(][0-9０-９]{1,2}[)）]|[0-9０-９]{1,2}[．.、]\s*\S|[a-zA-Z][.)]\s)"


@query("w1_line_groups", f"""with {LINES}, b as (select *, lag(size) over w as s1, lag(x0) over w as x1, lag(y0) over w as y1 from l window w as (partition by doc_id, page_no order by ord))
select doc_id, page_no, ord, (sum(case when abs(size - s1) <= 0.65 and abs(x0 - x1) <= 12 and y0 - y1 between 0 and s1 * 2.2::double and not regexp_matches(text, '{HEADS}') then 0 else 1 end) over (partition by doc_id, page_no order by ord) - 1)::bigint as block from b""")
def w1(spark, sf_dir):
    return L.group_lines(page_lines(spark, sf_dir), P).select("doc_id", "page_no", "ord", "block")


@query("a6_kind_counts", f"with {LINES} select doc_id, page_no, count(*) filter (kind = 'body') as body, count(*) filter (kind = 'large') as large, 0::bigint as small, 0::bigint as tiny, 0::bigint as \"table\" from l group by 1, 2")
def a6(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("doc_id", "page_no").pivot("kind", KINDS).count().fillna(0)


@query("w5_sections", f"""with {LINES} select doc_id, page_no, ord, coalesce(last_value(case when kind = 'large' then text end ignore nulls) over (partition by doc_id order by page_no, ord), '') as section,
row_number() over (partition by doc_id order by page_no, ord) as number from l""")
def w5(spark, sf_dir):
    b = blocks(spark, sf_dir)
    b = b.withColumn("is_section", L.is_section(F.col("kind"), F.col("size"), F.col("raw"), F.lit(9.0), P))
    return L.carry_sections(b, ["page_no", "ord"]).select("doc_id", "page_no", "ord", "section", "number")


@query("w3_reading_order", f"""with {LINES}, c as (select doc_id, page_no, count(distinct x0) > 1 as two from l group by 1, 2)
select doc_id, page_no, ord, case when two and x0 > 150 then 1 else 0 end as "column", row_number() over (partition by doc_id, page_no order by case when two and x0 > 150 then 1 else 0 end, y0, x0, ord) as rank from l join c using (doc_id, page_no)""")
def w3(spark, sf_dir):
    return L.reading_order(blocks(spark, sf_dir), P, 595.0).select("doc_id", "page_no", "ord", "column", "rank")


def _orders(b):
    """Recorded orders: on every third page, the text of line 2 and then the text of line 0."""
    keys = b.filter("page_no % 3 = 0 and ord in (0, 2)").groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct((-F.col("ord")).alias("o"), "raw"))).alias("k"))
    return keys.select("doc_id", "page_no", F.transform("k", lambda x: x["raw"]).alias("keys"))


@query("w4_manual_order", f"""with {LINES}, n as (select *, row_number() over (partition by doc_id, page_no, text order by ord) as k from l),
q as (select doc_id, page_no, text, row_number() over (partition by doc_id, page_no order by ord desc) - 1 as rank, ord as o from l where page_no % 3 = 0 and ord in (0, 2)),
q2 as (select doc_id, page_no, text, rank, row_number() over (partition by doc_id, page_no, text order by rank) as k from q),
j as (select n.doc_id, n.page_no, n.ord, coalesce(last_value(rank ignore nulls) over (partition by n.doc_id, n.page_no order by n.ord), -1) as lr from n left join q2 on q2.doc_id = n.doc_id and q2.page_no = n.page_no and q2.text = n.text and q2.k = n.k)
select doc_id, page_no, ord, row_number() over (partition by doc_id, page_no order by lr, ord) - 1 as position from j""")
def w4(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return R.manual_order(b, _orders(b)).select("doc_id", "page_no", "ord", "position")


@query("j5_manual_joins", f"""with {LINES}, v as (select *, lag(text) over (partition by doc_id, page_no order by ord) as a from l where ord % 4 <> 3),
ru as (select distinct doc_id, page_no, a, text as b from v where ord % 2 = 1 and a is not null),
g as (select v.doc_id, v.page_no, ord, sum(case when ru.b is null then 1 else 0 end) over (partition by v.doc_id, v.page_no order by ord) as grp from v left join ru on ru.doc_id = v.doc_id and ru.page_no = v.page_no and ru.a = v.a and ru.b = v.text)
select l.doc_id, l.page_no, l.ord, grp::bigint as "group" from l left join g on g.doc_id = l.doc_id and g.page_no = l.page_no and g.ord = l.ord""")
def j5(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("hidden", F.col("ord") % 4 == 3)
    live = Window.partitionBy("doc_id", "page_no").orderBy("ord")
    rules = b.filter("not hidden").withColumn("a", F.lag("raw").over(live)).filter("ord % 2 = 1 and a is not null").select("doc_id", F.col("page_no").alias("page"), "a", F.col("raw").alias("b"))
    return R.join_blocks(b, rules).select("doc_id", "page_no", "ord", "group")


def _exclusions(rows):
    """Recorded exclusions: short lines of page 0 mod 40 for any page, others of those pages for that page and place, and two that fit nothing,
    one of them for one page."""
    short = F.col("size") == 14.0
    page, pt = F.when(~short, F.col("page_no")).cast("long").alias("page"), F.when(short, F.lit(14.0)).alias("pt")
    told = rows.filter("page_no % 40 = 0 and size in (9.0, 14.0)").select("doc_id", "text", page, pt, F.when(~short, F.array(F.col("x0") + 0.5, "y0")).alias("at"))
    nothing = rows.groupBy("doc_id").agg(F.min("page_no").cast("long").alias("page"))
    nothing = nothing.select("doc_id", F.concat(F.lit("~"), "doc_id").alias("text"), F.explode(F.array("page", F.lit(None))).alias("page"), F.lit(None).cast("double").alias("pt"), F.lit(None).cast("array<double>").alias("at"))
    return told.unionByName(nothing)  # the one for any page is never reported


@query("j3_exclusions", f"""with {LINES}, x as (select distinct doc_id, text, page_no, x0, y0, size from l where page_no % 40 = 0)
select doc_id, page_no, ord, text from l where exists (select 1 from x where x.doc_id = l.doc_id and x.text = l.text and (x.size = 14 and l.size = 14 or x.size = 9 and x.page_no = l.page_no and x.x0 = l.x0 and x.y0 = l.y0))""")
def j3(spark, sf_dir):
    rows = page_lines(spark, sf_dir)
    return R.excluded(rows, _exclusions(rows)).select("doc_id", "page_no", "ord", "text")


@query("p27_unused_rules", "select source as doc_id, '~' || source as text, min(doc_id) as page from documents group by source")
def p27(spark, sf_dir):
    rows = page_lines(spark, sf_dir)
    return R.unused(rows, _exclusions(rows)).select("doc_id", "text", "page")


@query("j4_kind_overrides", f"""with {LINES}, a as (select distinct doc_id, text from l where page_no % 10 = 0 and ord = 0), b as (select distinct doc_id, page_no, text from l where page_no % 20 = 0 and ord = 0)
select l.doc_id, l.page_no, ord, case when b.text is not null then 'tiny' when a.text is not null then 'small' else kind end as kind
from l left join a on a.doc_id = l.doc_id and a.text = l.text left join b on b.doc_id = l.doc_id and b.page_no = l.page_no and b.text = l.text""")
def j4(spark, sf_dir):
    b = blocks(spark, sf_dir)
    none = F.lit(None).cast("array<double>").alias("at")
    any_page = b.filter("page_no % 10 = 0 and ord = 0").select("doc_id", F.lit(1).alias("rule_ord"), F.col("raw").alias("text"), F.lit(None).cast("long").alias("page"), none, F.lit("small").alias("kind")).distinct()
    one_page = b.filter("page_no % 20 = 0 and ord = 0").select("doc_id", F.lit(2).alias("rule_ord"), F.col("raw").alias("text"), F.col("page_no").alias("page"), none, F.lit("tiny").alias("kind"))
    return R.override_kinds(b, any_page.unionByName(one_page), ["doc_id", "page_no", "ord"]).select("doc_id", "page_no", "ord", "kind")


@query("a10_reasons", "select 'joins' as op, case when c_mktsegment = 'BUILDING' then 'unset' else c_mktsegment end as reason, count(*) as n from customer group by 1, 2 union all select 'splits', o_orderpriority, count(*) from orders group by 1, 2")
def a10(spark, sf_dir):
    joins = _table(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(" ").alias("reason"))
    return R.reasons({"joins": joins, "splits": _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("reason"))})


@query("k12_latest_settings", "select user_id as doc_id, event_id as version, props as settings from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def k12(spark, sf_dir):
    history = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("saved_at"), F.col("event_id").alias("version"), F.col("props").alias("settings"))
    return sinks.latest_settings(history).drop("saved_at")


@query("a13_progress", """with e as (select user_id as doc_id, event_type = 'click' as excluded, value > 50 as checked from events)
select doc_id, count(*) as total, count(*) filter (excluded) as excluded, count(*) filter (checked) as checked, least(count(*), count(*) filter (excluded) + count(*) filter (checked)) as done from e group by 1""")
def a13(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_type") == "click").alias("excluded"), (F.col("value") > 50).alias("checked"))
    return G.progress(e)


@query("a15_review_seconds", "select user_id as doc_id, round(avg(case when floor(value) > 0 then floor(value) end), 1) as seconds from events group by 1")
def a15(spark, sf_dir):
    return G.review_seconds(_table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.floor("value").cast("double").alias("seconds")))


@query("j7_point_in_cell", f"""with {LINES} select doc_id, page_no, ord, (case when y0 + 5 <= 150 then 0 else 1 end)::int as table_no,
(case when y0 + 5 <= 150 then case when y0 + 5 >= 96 then 2 when y0 + 5 >= 36 then 1 else 0 end else case when y0 + 5 >= 200 then 1 else 0 end end)::int as "row",
(case when y0 + 5 <= 150 then case when x0 + 50 >= 200 then 1 else 0 end else case when x0 + 50 >= 340 then 1 else 0 end end)::int as col from l where y0 + 5 <= 402""")
def j7(spark, sf_dir):
    rows = page_lines(spark, sf_dir).withColumn("cx", F.col("x0") + 50).withColumn("cy", F.col("y0") + 5)
    shape = F.array(F.struct(F.lit(0).alias("table_no"), *(F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, 500.0, 148.0))), F.array(*map(F.lit, (0.0, 200.0, 500.0))).alias("xbounds"), F.array(*map(F.lit, (0.0, 36.0, 96.0, 148.0))).alias("ybounds")),
                    F.struct(F.lit(1).alias("table_no"), *(F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (0.0, 100.0, 500.0, 400.0))), F.array(*map(F.lit, (0.0, 340.0, 500.0))).alias("xbounds"), F.array(*map(F.lit, (100.0, 200.0, 400.0))).alias("ybounds")))
    tables = rows.select("doc_id", "page_no").distinct().select("*", F.inline(shape))
    return T.lines_in_tables(rows, tables)


@query("j9_nested_frames", """with t as (select l_orderkey as page_no, l_linenumber as table_no, l_suppkey % 5 as a, 5 + l_linenumber % 4 as w from lineitem),
b as (select page_no, table_no, a * 10.0::double as x0, a * 10.0::double as y0, (a + w) * 10.0::double as x1, (a + w) * 10.0::double as y1 from t)
select page_no, table_no from b where not exists (select 1 from b i where i.page_no = b.page_no and i.table_no <> b.table_no and b.x0 <= i.x0 + 1 and b.y0 <= i.y0 + 1 and b.x1 >= i.x1 - 1 and b.y1 >= i.y1 - 1 and (b.x1 - b.x0) * (b.y1 - b.y0) > (i.x1 - i.x0) * (i.y1 - i.y0))""")
def j9(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("page_no"), F.col("l_linenumber").alias("table_no"), (F.col("l_suppkey") % 5).alias("a"), (5 + F.col("l_linenumber") % 4).alias("w"))
    lo, hi = F.col("a") * F.lit(10.0), (F.col("a") + F.col("w")) * F.lit(10.0)
    return T.outermost(t.select("doc_id", "page_no", "table_no", lo.alias("x0"), lo.alias("y0"), hi.alias("x1"), hi.alias("y1"))).select("page_no", "table_no")


@query("j10_duplicate_pairs", f"""with {LINES}, k as (select *, regexp_replace(text, '\\s+', '', 'g') as key from l)
select a.doc_id, a.page_no, a.ord as a_ord, b.ord as b_ord, 1.0::double as ratio from k a join k b on a.doc_id = b.doc_id and a.page_no = b.page_no and a.key = b.key and a.ord // 4 = b.ord // 4 and a.x0 = b.x0 and a.ord < b.ord where a.key <> ''""")
def j10(spark, sf_dir):
    b = blocks(spark, sf_dir)
    y = F.floor(F.col("ord") / 4) * F.lit(12.0)
    b = b.withColumn("y0", y).withColumn("y1", y + 10).withColumn("x1", F.col("x0") + 100)
    return T.duplicate_pairs(b).select("doc_id", "page_no", "a_ord", "b_ord", "ratio")


# Whole pages and documents.


@query("a9_run_log", f"""with {SENTENCES}, h as (select doc_id, count(*) as n_units from s where {HIT} group by 1)
select doc_id, count(*) as n_sentences, count(distinct page_no) as n_page_units, count(*) filter (kind = 'body') as body, count(*) filter (kind = 'large') as large, 0::bigint as small, 0::bigint as tiny, count(*) filter (kind = 'table') as "table",
count(distinct section) as n_sections, sum(length(sentence))::bigint as n_chars, coalesce(any_value(n_units), 0)::bigint as n_units, round_even(count(*)::double / count(distinct page_no), 1) as sentences_per_page from s left join h using (doc_id) group by doc_id""")
def a9(spark, sf_dir):
    rows = sentences(spark, sf_dir)
    return G.run_log(_pages(spark, sf_dir).select("doc_id"), rows, rows.filter(F.col("sentence").rlike(keyword_pattern(WORDS))))


@query("a11_hits_by_page", f"with {SENTENCES} select doc_id, page_no, count(*) as n_hits from s where {HIT} group by 1, 2")
def a11(spark, sf_dir):
    return G.hits_by_page(sentences(spark, sf_dir, False), keyword_pattern(WORDS))


@query("c11_page_suggestions", f"""with {LINES}, f as (select doc_id, page_no, count(*) as n_lines, sum(length(text))::bigint as n_chars, count(*) filter (regexp_matches(text, '[0-9]{{1,3}}\\s*$')) as n_tails, bool_or(size = 14) as big,
    coalesce(string_agg(text, '／' order by ord) filter (size = 14), '') as heads, bool_or(regexp_matches(text, '(?i)^(目\\s*次|もくじ|CONTENTS?|INDEX)$') and (size = 14 or not exists (select 1 from l m where m.doc_id = l.doc_id and m.page_no = l.page_no and m.size = 14))) as titled from l group by 1, 2),
p as (select source as doc_id, doc_id as page, row_number() over (partition by source order by doc_id) as page_no, count(*) over (partition by source) as n from documents),
j as (select p.doc_id, p.page_no, n, coalesce(n_lines, 0) as n_lines, coalesce(n_chars, 0) as n_chars, coalesce(n_tails, 0) as n_tails, coalesce(big, false) as big, coalesce(heads, '') as heads, coalesce(titled, false) as titled, p.page_no <= greatest(10, n * 0.15::double) as early from p left join f on f.doc_id = p.doc_id and f.page_no = p.page),
c as (select doc_id, page_no, case when page_no = 1 then ['cover', 'first page'] when page_no = n and n_chars < 300 then ['cover', 'last page of ' || n_chars || ' characters'] when early and titled then ['contents', 'largest heading']
    when early and n_lines >= 10 and n_tails * 10 >= n_lines * 4 then ['contents', (n_tails * 100 // n_lines) || '% of lines end in a number']
    {" ".join(f"when regexp_matches(heads, '(?i){x}') then ['{r}', 'heading: ' || regexp_extract(heads, '(?i)({x})', 1)]" for r, x in G.HEADINGS.items())}
    when n_chars < 250 and n_lines <= 12 and 14 >= 9 * 1.8::double and big then ['divider', n_chars || ' characters under a large heading'] end as c from j)
select doc_id, page_no, c[1] as reason, c[2] as why from c where c is not null""")
def c11(spark, sf_dir):
    pages = _table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"))
    pages = pages.withColumn("page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    lines = page_lines(spark, sf_dir).withColumnRenamed("page_no", "page").join(pages, ["doc_id", "page"])
    return G.suggest_skips(pages.drop("page"), G.page_features(lines, pages.select("doc_id", F.lit(9.0).alias("body")).distinct())).select("doc_id", "page_no", "reason", "why")


@query("a20_task_status", """with n as (select user_id as doc_id, arg_max(event_type, event_id) as state from events group by 1), p as (select user_id as doc_id, list(event_id order by event_id) as pages from events where event_type = 'purchase' group by 1)
select doc_id, task_no::int as task_no, task, case when task = 'cover' and pages is not null then 'skipped' when task = 'contents' and state in ('view', 'click') then state else 'unchecked' end as state,
coalesce(case when task = 'cover' then len(pages) end, 0)::int as n_pages, case when task = 'contents' and state in ('view', 'click') then 'm' else '' end as memo from n left join p using (doc_id) cross join (values (0, 'cover'), (1, 'contents'), (2, 'divider')) t(task_no, task)""")
def a20(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", "event_type")
    skips = e.filter("event_type = 'purchase'").select("doc_id", F.col("event_id").cast("int").alias("page"), F.lit("cover").alias("reason"), F.lit(0).alias("rule_ord"))
    notes = e.select("doc_id", F.lit("contents").alias("task"), F.col("event_type").alias("state"), F.lit("m").alias("memo"), F.col("event_id").alias("rule_ord"))
    out = G.task_status(e.select("doc_id").distinct(), ["cover", "contents", "divider"], skips, notes, ("view", "click"))
    return out.select("doc_id", "task_no", "task", "state", F.size("pages").alias("n_pages"), "memo")


@query("a14_audit", """with u as (select user_id as doc_id, event_type <> 'click' as adopted, value > 50 as checked from events)
select doc_id, count(*) as total, count(*) filter (adopted) as n_adopted, count(*) filter (checked) as n_checked, count(*) filter (checked or not adopted) as done, count(*) filter (not checked and adopted) as left_over from u group by 1""")
def a14(spark, sf_dir):
    u = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_type") != "click").alias("adopted"), (F.col("value") > 50).alias("checked"))
    return G.audit(u.select("doc_id").distinct(), u)


@query("s9_cache_state", "select c_custkey as doc_id, case when o.k is null then 'none' when o.n % 2 = 0 and c_nationkey % 2 = 0 then 'ok' else 'stale' end as state from customer left join (select o_custkey as k, count(*) as n from orders group by 1) o on o.k = c_custkey")
def s9(spark, sf_dir):
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("mtime"), F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("sig"))
    built = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg((F.count("*") % 2).alias("mtime"), F.lit("even").alias("sig"))
    return files.cache_state(docs, built).select("doc_id", "state")


# Steps that are folds, and the whole extraction; their tests hold them against plain loops.


def _boxed(spark, sf_dir):
    width = F.least(F.length("text") * F.lit(4.0), F.lit(250.0))
    return page_lines(spark, sf_dir).withColumn("x1", F.col("x0") + width).withColumn("y1", F.col("y0") + F.lit(10.0))


@query("w2_fragment_merge")
def w2(spark, sf_dir):
    """Pairs of lines lie in one row, the second where the first ends."""
    rows = _boxed(spark, sf_dir).withColumn("y0", F.floor(F.col("ord") / 2) * F.lit(12.0)).withColumn("x0", F.when(F.col("ord") % 2 == 1, F.col("x0") + 255.0).otherwise(F.col("x0")))
    return folds.merge_fragments(rows, P.join_gap).select("doc_id", "page_no", "ord", "text", "x0", "x1", "y0")


@query("c5_duplicates_dropped")
def c5(spark, sf_dir):
    b = _boxed(spark, sf_dir).withColumnRenamed("text", "raw").withColumn("y0", F.floor(F.col("ord") / 4) * F.lit(12.0)).withColumn("y1", F.col("y0") + 10.0)
    return folds.drop_duplicates(b).select("doc_id", "page_no", "ord", "raw", "size")


@query("c4_table_rows", f"""with {LINES}, c as (select *, y0 + 5 as cy, case when x0 > 150 then 1 else 0 end as col, case when y0 + 5 >= 96 then 2 when y0 + 5 >= 36 then 1 else 0 end as "row" from l where y0 + 5 <= 150),
t as (select doc_id, page_no, "row", col, string_agg(text, '' order by round_even(cy / size / 0.8::double, 0), x0, ord) as x from c group by 1, 2, 3, 4)
select doc_id, page_no, 0::int as table_no, "row"::int as "row", string_agg(x, ' ' order by col) as raw from t group by 1, 2, 4""")
def c4(spark, sf_dir):
    rows = page_lines(spark, sf_dir).withColumn("x1", F.col("x0") + 100.0).withColumn("y1", F.col("y0") + 10.0)
    edges = [0.0, 36.0, 96.0, 148.0]
    cells = F.array(*(F.array(*map(F.lit, (x, a, y, b))) for a, b in zip(edges, edges[1:]) for x, y in ((0.0, 200.0), (200.0, 500.0))))
    tables = rows.select("doc_id", "page_no").distinct().select("*", F.lit(0).alias("table_no"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(148.0).alias("y1"), cells.alias("cells"))
    return T.table_rows(rows, T.usable(tables)).select("doc_id", "page_no", "table_no", "row", "raw")


@query("c8_units_with_merges")
def c8_edits(spark, sf_dir):
    """Every 40th hit takes in the sentence three further on."""
    rows = sentences(spark, sf_dir)
    later = rows.select("doc_id", (F.col("ord") - 3).alias("ord"), F.col("sentence").alias("more"))
    merges = rows.filter("ord % 40 = 0").join(later, ["doc_id", "ord"]).select("doc_id", F.col("page_no").alias("page"), F.col("sentence").alias("hit"), F.array("more").alias("add"), F.lit("same matter").alias("reason"), F.col("ord").alias("rule_ord"))
    return folds.units_with_edits(rows, keyword_pattern(WORDS), merges, _excludes(rows))


@query("c2_extract")
def c2(spark, sf_dir):
    """Every step from lines to sentences, pages and columns joined, with recorded exclusions."""
    pages = _table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"))
    pages = pages.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")))  # a number a page
    rows = _boxed(spark, sf_dir).join(pages, ["doc_id", "page_no"]).withColumn("page_no", F.col("number")).drop("number")
    rows = X.cut(L.without_running(rows, L.running_lines(rows, P)))
    body = X.cut(rows.select("doc_id").distinct().withColumn("body", F.lit(9.0)))
    rules = {"excluded": X.cut(_exclusions(rows).withColumn("at", F.lit(None).cast("array<double>")))}
    return X.sentences(X.blocks(rows, body, P, 595.0, rules=rules, spent=(rows,)), p=P)
