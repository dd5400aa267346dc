"""Batch conversion of a corpus: what the exports hold, how they are written, what the cache gives back."""

import pytest
from pyspark.sql import functions as F

from pagelathe.plans import batch, extract
from pagelathe.sources import files

DOCS = "doc_id string, file string, n_pages int, body_pt double, saved boolean"
ROWS = "sentence string, kind string, page_no int, doc_id string"


@pytest.fixture(scope="module")
def tables(spark):
    names = spark.createDataFrame([("Sample_2024", "Sample_2024.pdf", 3, 9.0, True), ("Blank_2023", "Blank_2023.pdf", 2, 0.0, False)], DOCS)
    groups = spark.createDataFrame([("Sample_2024", "one")], "key string, grp string")
    rows = extract.extract(files.sample_spans(spark))
    excludes = spark.createDataFrame([("Sample_2024", 3, "LLM研修百人八十人。", "no", 0)], "doc_id string, page int, text string, reason string, rule_ord int")
    return batch.exports(batch.described(names, groups), rows, excludes=excludes)


def _read(spark, path, columns):
    """The lines of a CSV folder in the order of its files, without the header and its mark."""
    rows = spark.read.text(path).withColumn("f", F.input_file_name()).withColumn("n", F.monotonically_increasing_id()).orderBy("f", "n").collect()
    lines = [r.value.lstrip("\ufeff") for r in rows]
    head = ",".join(columns)
    assert head in lines
    return [x for x in lines if x != head]


def test_exports_agree(tables):
    rows = tables["sentences"].orderBy("ord").collect()
    pages = tables["pages"].orderBy("page_no").collect()
    assert rows and {(r.company, r.year, r.grp) for r in rows} == {("Sample", "2024", "one")}
    for p in pages:  # a plain loop over the sentences
        own = [r for r in rows if r.page_no == p.page_no]
        assert (p.n_sentences, p.n_chars, p.body, p.section, p.page_label) == (len(own), sum(len(r.sentence) for r in own), "".join(r.sentence for r in own), own[0].section, own[0].page_label)
    lines = [r.line for r in tables["tagged"].orderBy("doc_id", "ord", "part").collect()]
    assert [x for x in lines if x.startswith("<h1>")] == [f"<h1>{r.doc_id}</h1>" for r in tables["document_vars"].orderBy("doc_id").collect()] == ["<h1>Blank_2023</h1>", "<h1>Sample_2024</h1>"]
    assert [x for x in lines if x.startswith("<h2>")] == [f"<h2>p{p.page_no}</h2>" for p in pages]
    log = {r.file: r for r in tables["log"].collect()}
    assert (log["Blank_2023.pdf"].n_sentences, log["Blank_2023.pdf"].settings, log["Blank_2023.pdf"].sentences_per_page) == (0, "default", 0.0)
    assert (log["Sample_2024.pdf"].n_sentences, log["Sample_2024.pdf"].n_page_units, log["Sample_2024.pdf"].n_chars) == (len(rows), len(pages), sum(len(r.sentence) for r in rows))
    rates = {r.doc_id: r for r in tables["rates"].collect()}
    assert rates["Sample_2024"].n_pages == 3 and rates["Blank_2023"].sentence_rate_pct == 0.0
    units = tables["units"].orderBy("anchor").collect()
    assert len(units) == rates["Sample_2024"].n_hit_sentences == log["Sample_2024.pdf"].n_units and [u.unit_id for u in units] == [f"Sample_2024-{i + 1}" for i in range(len(units))]


def test_written(spark, tables, tmp_path):
    path = str(tmp_path / "out")
    made = batch.write_exports(tables, path, "adopted")
    assert made == [*batch.COLUMNS, "tagged", "texts", "units_by_adopted"] and {p.name for p in (tmp_path / "out").iterdir()} == set(made)
    assert len(_read(spark, f"{path}/sentences", batch.COLUMNS["sentences"])) == tables["sentences"].count()
    assert _read(spark, f"{path}/document_vars", batch.COLUMNS["document_vars"]) == ["Blank_2023,Blank,2023,\"\"", "Sample_2024,Sample,2024,one"]
    parts = sorted((tmp_path / "out" / "texts" / "doc_id=Sample_2024").glob("*.txt"))
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text == [r.line for r in tables["tagged"].filter("doc_id = 'Sample_2024'").orderBy("ord", "part").collect()]
    with pytest.raises(ValueError):
        batch.write_exports(tables, path, "x/y", overwrite=True)
    with pytest.raises(Exception):
        batch.write_exports(tables, path)


def test_faults(spark):
    spans = files.sample_spans(spark)
    docs = spark.createDataFrame([("Sample_2024",), ("none",), ("bad",)], "doc_id string")
    bad = spans.limit(2).withColumns({"doc_id": F.lit("bad"), "size": F.lit(None).cast("double")})
    assert sorted(map(tuple, batch.faults(docs, spans.unionByName(bad)).collect())) == [("bad", "2 spans without page, box or size"), ("none", "no spans")]


def test_looked_up(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def analyse(docs):
        seen.append(sorted(r.doc_id for r in docs.collect()))
        return docs.selectExpr("concat(doc_id, ' ', sig) as sentence", "'body' as kind", "1 as page_no", "doc_id")

    docs = lambda sig: spark.createDataFrame([("007", 1, "s"), ("a", 1, sig)], "doc_id string, mtime int, sig string")
    rows, manifest = batch.looked_up(docs("s"), docs("s").limit(0), analyse, path, ROWS)
    assert sorted(r.sentence for r in rows.collect()) == ["007 s", "a s"]
    rows, manifest = batch.looked_up(docs("t"), manifest, analyse, path, ROWS)
    assert sorted(r.sentence for r in rows.collect()) == ["007 s", "a t"] and seen == [["007", "a"], ["a"]]
    assert sorted((r.doc_id, r.sig) for r in manifest.collect()) == [("007", "s"), ("a", "t")]
    units = spark.createDataFrame([("a", True, False), ("a", False, True)], "doc_id string, adopted boolean, checked boolean")
    assert sorted((r.doc_id, r.n_units, r.n_adopted, r.n_checked) for r in batch.counted(manifest, units).collect()) == [("007", 0, 0, 0), ("a", 2, 1, 1)]
