"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and other columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelathe.llm import common, exact_dedup, exact_topk, language_id, license_scan, line_quality, ngram_join, packing, queries, source_mix, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket string, _row int, size int"


def made():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(50)
    docs = [base, base.upper(), base + "\n", " ".join(base.split()[:-9]), "x " + base, passage, f"{text(20)} {passage}\t{text(30)}", f"{passage} {text(3)} {passage}", "", None, " \t\n", "a", "A ", "a b c d", "a b c d e", "a b c d e f", text(6000), "\x0b", text(200), "1 2 3 !!"]
    for _ in range(12):  # near copies of each other, not all of the first
        words = base.split()
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append(" ".join(words))
    small = text(8).split()
    docs += [" ".join(small), " ".join([*small, "zz"]), " ".join(small[:-1])]
    docs += [text(rng.randint(1, 60)) for _ in range(15)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 0, 1, "b", 2, 3) for i, t in enumerate(docs)]
    return [*rows, rows[5], rows[17], (None, base, None, None, None, None, None, None, None)]


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def ascii_lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.mark.parametrize("boundary", [None, 0, 9])
def test_ngram_join(docs, boundary, monkeypatch):
    if boundary is not None:
        monkeypatch.setattr(ngram_join, "boundary_by_cost", lambda *a: boundary)
    sets = []
    for i, t, *_ in ROWS:
        w = words(ascii_lower(t))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((sets[k][0] for k in range(len(sets)) if group[k] == g and sets[k][0] is not None), default=None) for g in set(group)}
    want = Counter((i, len(s), least[g]) for (i, s), g in zip(sets, group))
    assert Counter(map(tuple, ngram_join.jaccard_components(docs).collect())) == want


def test_one_of_each_by_rows(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(n))
    first, second, third = text(60), text(60), text(60)
    rows = [(None, text(40)), (None, text(40)), (None, first), (7, "x " + first), (7, first + " y"), (7, second), (3, second + " z"), (None, third + " w"), (None, third), (None, ""), (None, None), (9, ""), (9, " "), (8, text(40)), (8, text(40)), (None, second)]
    rows = [(i, t, k) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, row_id int").coalesce(1).write.parquet(str(tmp_path / "t"))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(ascii_lower(t))) else set() for _, t, _ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    want = [min((rows[k] for k in range(len(rows)) if group[k] == g), key=lambda r: (r[0] is None, r[0] or 0, r[2])) for g in set(group)]
    got = ngram_join.one_of_each(spark.read.parquet(str(tmp_path / "t")))
    assert len(want) == len(rows) - 5 and Counter(map(tuple, got.collect())) == Counter(want)


def test_need_is_exact():
    for n in range(1, 40):
        for m in range(1, 40):
            need = ngram_join.need(n, m, 75)
            assert 100 * need >= 75 * (n + m - need) and not 100 * (need - 1) >= 75 * (n + m - need + 1)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i) for i in range(230)]
    rows += [(230 + i, rows[50][1], 0) for i in range(9)] + [(300, None, 0), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (400, [float("nan")] * 6, 0), (450, [1e18] * 6, 0), (451, [1e18 - 1e3] * 5 + [-3.0], 0), (452, [-1e200] * 6, 0), (500, [1.0, 2.0], 0), (501, [3.0, 1.0], 0), (None, [1.0] * 6, 0), (550, [], 0), (7, rows[7][1], 0), (100, [-9.0] * 6, 0)]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in whole:
        if i % 50 == 0:
            queries[i] = min(v, queries.get(i, v))
    want = Counter()
    for q, a in queries.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))[:5]
        want.update((q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert Counter(map(tuple, exact_topk.top_k(table).collect())) == want
    assert exact_topk.top_k(table.limit(0)).count() == 0


def test_top_k_reads_few_vectors(spark):
    rng = np.random.default_rng(1)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 16)))], "vec_id long, embedding array<double>")
    found, read = exact_topk.search(table)
    assert found.count() == 60 * 5 and read.count() < 60 * 3000 // 50


def test_cells_bound_the_product():
    rng = np.random.default_rng(1)
    for size in (1.0, 1e6, 1e30):
        v = np.floor(256 * size * rng.normal(size=(500, 16)))
        low, high = exact_topk.Cells(v).bounds(v[:20])
        exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in v] for x in v[:20]], object)
        assert (low <= exact).all() and (exact <= high).all()


def test_sortable():
    numbers = [-(10**40), -(10**19) - 1, -(10**19), -101, -100, -99, -10, -9, -1, 0, 1, 9, 10, 99, 10**19, 10**40]
    assert sorted(numbers, key=exact_topk._sortable) == numbers


def test_source_mix(docs, empty):
    got = source_mix.taken_words(docs, block_words=8).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(words(t))) for i, t, *_ in ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r["source_size"], r["target"]][0] += r["taken"]
    assert all(abs(taken - target) <= 8 for (_, target), (taken, _) in by.items())
    assert Counter(map(tuple, source_mix.taken_words(docs, block_words=8).collect())) == Counter(map(tuple, got))
    mixed = source_mix.mixed_blocks(docs.dropDuplicates(["doc_id"]), block_words=8)
    total = mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert total == sum(r["taken"] for r in source_mix.taken_words(docs.dropDuplicates(["doc_id"]), block_words=8).collect())
    assert source_mix.taken_words(empty).count() == 0


def test_mix_by_rows(spark):
    ids = [None, None, None, 1, 1, 1, 2, 3]
    sizes = [50, 90, 130, 70, 70, 110, 40, 200]
    rows = [(i, " ".join(f"r{k}_{w}" for w in range(n)), "ab"[k % 2]) for k, (i, n) in enumerate(zip(ids, sizes))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = {"block_words": 16, "weights": (3, 1), "share": 1.5, "most": 2}
    want = Counter((r["doc_id"], r["size"], r["taken"]) for r in source_mix.taken_words(table, **how).collect() if r["taken"])
    whole, pieces = defaultdict(Counter), defaultdict(Counter)
    for r in source_mix.mixed_documents(table, **how).collect():
        of = {w.split("_")[0] for w in words(r["text"])}
        assert len(of) == 1 and not whole[(*of, r["doc_id"])]
        whole[(*of, r["doc_id"])] = Counter(words(r["text"]))
    for r in source_mix.mixed_blocks(table, **how).collect():
        for w in words(r["text"]):
            pieces[(w.split("_")[0], r["doc_id"])][w] += 1
    for found in (whole, pieces):
        assert all(max(c.values()) <= 2 and ids[int(k[1:])] == i for (k, i), c in found.items())
        assert Counter((i, sizes[int(k[1:])], sum(c.values())) for (k, i), c in found.items()) == want


def test_fill_and_permutation():
    assert source_mix.fill([100, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert source_mix.fill([10, 1000], [3, 1], 1.5, 2) == [20, 1495]
    for size in (1, 2, 3, 17, 1000):
        assert sorted(source_mix.permuted(np.arange(size), size, 9)) == list(range(size))


def test_language(spark, docs, empty):
    rng = random.Random(1)
    kinds = {"aa": ["bana", "kola", "mira"], "bb": ["str", "krt", "plz"], "cc": ["éñü", "öäé", "ñoñ"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k) for i, k in enumerate(list(kinds) * 30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table, table.filter("doc_id % 4 <> 2").select("doc_id", F.col("lang").alias("label")))
    got = {r["doc_id"]: r for r in language_id.identify(table, model).collect()}
    assert all(got[i]["lang_pred"] == k and got[i]["score"] > 0.5 for i, _, k in rows)
    odd = {str(r["doc_id"]): r for r in language_id.identify(docs, model).collect()}
    assert odd["8"]["lang_pred"] == odd["9"]["lang_pred"] == odd["10"]["lang_pred"] == odd["19"]["lang_pred"] == "und"
    assert {str(r["doc_id"]) for r in language_id.recognised(docs, model).collect()}.isdisjoint({"8", "9", "10", "19"})
    none = language_id.train(empty, empty.select("doc_id", F.col("lang").alias("label")))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_codewords_correct_errors():
    code = language_id.codewords(6).astype(int)
    distance = [(code[a] != code[b]).sum() for a in range(6) for b in range(a)]
    assert code.shape == (6, 31) and min(distance) >= 16


def test_substring_dedup(docs, empty):
    every = [words(t) for _, t, *_ in ROWS]
    starts = Counter(tuple(w[i : i + 35]) for w in every for i in range(len(w) - 34))
    want = Counter()
    for (i, *_), w in zip(ROWS, every):
        gone = {k for p in range(len(w) - 34) if starts[tuple(w[p : p + 35])] > 1 for k in range(p, p + 35)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter(tuple(r)[:4] for r in got) == want
    by_id = {r[0]: words(r[1]) for r in ROWS}
    for r in got:
        for at, n, other, there in zip(r["start"] or [], r["words"] or [], r["ref_doc"] or [], r["ref_start"] or []):
            if other in by_id and r["doc_id"] in by_id:
                assert n >= 35 and by_id[r["doc_id"]][at : at + n] == by_id[other][there : there + n]
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("first", [1, 64])
def test_exact_dedup(docs, empty, first):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    want = Counter()
    for k, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for n, m in enumerate(members):
            want[m[2], members[0][2], len(members), n == 0, hashlib.sha256(k.encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(docs, first_digit=first).drop("row_id").collect()
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.without_copies(docs).count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, " ".join([rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(40)] + ["grumfox" + rng.choice("abc")] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(table, table.select("doc_id", "label"))
    assert "grumfox*" in model.lexicon.entries
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert model.lexicon.hits("what an 1d10t")[0] == ["idiot*"] and model.lexicon.hits("take the trash can out")[0] == [] and model.lexicon.hits("ѕtupіd!")[0] == ["stupid*"]
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, toxicity.train(empty, empty.select("doc_id", F.lit(1).alias("label")))).count() == 0


def test_toxicity_matcher_against_brute_force():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({"zonk": 2.0, "zonkers*": 3.0, "abcdefghijklmnopqrst": 5.0, "grum*": 1.5, "grumble": 4.0, "trash can*": 1.0})
    words = ["zonk", "Z0NK", "zonkers", "zonkersx", "trash", "can", "bin", "clown", "fish", "car", "idiot", "proof", "1diot", "grum", "grumble", "grumbles", "abcdefghijklmnopqrst", "abcdefghijklmnopqrstu", "x", ",", "42"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        folded = toxicity.fold(text)
        inside = {i for e in toxicity.EXCEPTIONS for i in range(len(folded)) if folded.startswith(f" {e} ", i) for i in range(i, i + len(e) + 1)}
        weight, n = 0.0, 0
        for i, c in enumerate(folded):
            here = [w for e, w in lexicon.entries.items() if folded.startswith(" " + e[:-1] if e.endswith("*") else f" {e} ", i)]
            if here and i not in inside:
                weight, n = weight + max(here), n + 1
        got = lexicon.hits(text)
        assert len(got[0]) == n and got[1] == pytest.approx(weight), text


def test_toxicity_time_is_linear():
    import time

    lexicon = toxicity.Lexicon({})
    begin = time.time()
    assert lexicon.hits("trash can idiot " * 100_000)[0] == ["idiot*"] * 100_000
    assert time.time() - begin < 10


def test_toxicity_learns_from_few_labels(spark):
    rng = random.Random(9)
    plain = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(30))
    rows = [(i, plain() + (" internationalisationisms" if i < 4 else ""), int(i < 4)) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, toxicity.train(table, table.select("doc_id", "label"))).collect()}
    assert all((got[i] >= 0.5) == (i < 4) for i in got)


def test_quality(spark, docs, empty):
    rng = random.Random(4)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "river", "runs", "slowly", "over", "stones"]) for _ in range(12)) + "." for _ in range(4))
    bad = lambda: "\n".join("BUY!! NOW!! CHEAP!! $$$ &&& *** " * 3 for _ in range(4))
    rows = [(i, bad() if i % 3 == 0 else good(), int(i % 3 != 0)) for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = line_quality.train(table, table.select("doc_id", "label"))
    got = {r["doc_id"]: r["score"] for r in line_quality.score(table, model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows)
    assert line_quality.score(docs, model).count() == len(ROWS)
    assert line_quality.score(empty, line_quality.train(empty, empty.select("doc_id", F.lit(1).alias("label")))).count() == 0


def test_chain_marginals():
    """Forward-backward against summing over all labellings."""
    rng = np.random.default_rng(0)
    text = np.array([0, 0, 0, 0, 1, 2, 2])
    u, t = rng.normal(size=7), rng.normal(size=(2, 2))
    fwd, bwd = line_quality.chain(u, text, t)
    got = 1 / (1 + np.exp(-(fwd + bwd)))
    for d in range(3):
        at = np.flatnonzero(text == d)
        total, up = 0.0, np.zeros(len(at))
        for code in range(1 << len(at)):
            y = [code >> k & 1 for k in range(len(at))]
            p = np.exp(sum(u[a] * b for a, b in zip(at, y)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            total += p
            up += p * np.array(y)
        assert np.allclose(got[at], up / total)


PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def test_license_scan(spark, empty):
    texts = ["Licensed under CC BY-NC 4.0.", "all Rights,\nreserved. cc\tby cc-BY", "GNU General Public Licenses", "general public license general public license", "accc by", None, "", "Released under the MIT License.\nmore", "Released the MIT", "ccébby cc by é", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, label string")
    for r in license_scan.scan(table).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(texts[r["doc_id"]]))
        at = [(k, name) for name, p in PHRASES.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None)), texts[r["doc_id"]]
        assert r["base_labels"] == ",".join(sorted({n for _, n in at}))
        more = set()
        for line in ascii_lower(texts[r["doc_id"]]).split("\n"):
            have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
            for name, t in license_scan.TEMPLATES:
                need = set(re.findall(r"[a-z0-9]+", t.lower()))
                if len(have & need) >= -(-9 * len(need) // 10):
                    more.add(name)
        assert r["labels"] == ",".join(sorted(more | {n for _, n in at}))
    assert license_scan.scan(empty).count() == 0


def test_license_scan_after_wide_characters(spark):
    texts = ["\U0001F600\U0001F600\U0001F600 one cc by two cc by", "\U0001F600 \U0001F600 cc by", "one \U0001D54F\U0001D54F two\nall rights reserved \U0001F600"]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["first_word"], r["last_word"], r["n_base"]) for r in got] == [(2, 5, 2), (2, 2, 1), (3, 3, 1)]


def test_license_scan_of_wrapped_notices(spark):
    rng = random.Random(4)
    notices, texts, want = [(n, t.split()) for n, t in license_scan.TEMPLATES], ["Permission is\nhereby granted.\n\nSoftware files."], [""]
    for name, notice in notices:
        for gap in ("\n", "\n * ", "\r\n# ", "\n\n"):
            for before in (0, 7, 30, 200):
                at = sorted(rng.sample(range(1, len(notice)), 2))
                text = gap.join(" ".join(x) for x in (notice[: at[0]], notice[at[0] : at[1]], notice[at[1] :]))
                texts.append(f"{'zig zag ' * before}{text}\n\nzig {'zag ' * before}")
                want.append(name)
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert want[r["doc_id"]] in r["labels"].split(","), texts[r["doc_id"]]
        assert set(r["labels"].split(",")) <= {want[r["doc_id"]], "gpl", "cc-by", "reserved"}, texts[r["doc_id"]]
    assert len(got) == len(texts)


def test_packing(docs, empty):
    path, ranks = queries.tokenizer_files()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in ROWS}
    got = packing.pack(docs, path, ranks, with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == piece and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    times = Counter(i for i, *_ in ROWS)
    assert sum(r["length"] for r in got) == sum(len(ids[i]) * n for i, n in times.items())
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(empty, path, ranks).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", " lead", "trail ", "x\n y", "x \ny", "it's <|endoftext|> here", "é ñ  ü", "\x1c a \x1d", "12 3a !! ?"])
def test_ids_equal_the_tokenizers(text):
    path, ranks = queries.tokenizer_files()
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    for r in (None, ranks):
        assert packing.Ids(path, r).of(pa.array([text, "a b", text]))[2].tolist() == [*want, 0]


def test_best_fit_one_by_one():
    rng = random.Random(8)
    for _ in range(30):
        sizes = [rng.randint(1, 99) for _ in range(rng.randint(1, 200))]
        open_ = []
        for n in sorted(sizes, reverse=True):
            fit = min((c for c in open_ if c >= n), default=None)
            if fit is None:
                open_.append(100 - n)
            else:
                open_.remove(fit)
                open_.append(fit - n)
        runs, windows = packing.best_fit(Counter(sizes), 100)
        left = Counter()
        for n, _, items, first, _ in runs:
            for k in range(items):
                left[first + k] += n
        assert windows == len(open_) and sorted(100 - x for x in left.values()) == sorted(open_)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row_id long, doc string, runs int, dealt int, bucket string, _row int, _id int, node long, kind int"


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on its predecessor's rows: rows with null and repeated doc_ids, null texts, copies, near copies and columns of clashing names."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(12)
    kinds = {"aa": ["bana", "kola", "mira", "tolo"], "bb": ["strk", "krtn", "plzt", "vrst"], "cc": ["éñü", "öäé", "ñoñ", "üéö"]}
    text = lambda k, n: " ".join(rng.choice(kinds[k]) + rng.choice("abcdefgh") * rng.randint(0, 3) for _ in range(n))
    rows = [(i, text(k, rng.randint(20, 90)), k, f"s{i % 3}") for i, k in enumerate(list(kinds) * 12)]
    base = rows[4][1]
    near = base.split()
    near[3] = "other"
    rows += [(100, base + "\n", "bb", None), (None, " " + base, "bb", "s1"), (None, text("aa", 50), "aa", "s2"), (None, text("aa", 51), "aa", "s2"), (7, text("bb", 60), "bb", "s0"), (101, " ".join(near), "bb", "s1"), (102, None, None, None), (103, "12 34 !!", "aa", "s0"), (104, "", "aa", "s0"), (105, " \t", None, "s0")]
    table = spark.createDataFrame([(*r, len(r[1] or ""), 1, "d", 2, 3, "b", 4, 5, 6, 7) for r in rows], CLASHING)
    table.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    keys = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())

    known = common.materialize(stages["language_id"](spark, docs, sf))
    model = queries.language_model(docs)
    want = Counter((i, t, s) for i, t, _, s in rows if t and re.search(r"[^\W\d_]", t) and not language_id.predicted(model, [t], language_id.SURE)[2][0])
    assert known.columns == docs.columns and keys(known) == want and len(want) >= 40

    single = common.materialize(stages["exact_dedup"](spark, known, sf))
    groups = defaultdict(list)
    for i, t, s in want.elements():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, (i, t, s)))
    want = Counter(min(g)[3] for g in groups.values())
    assert single.columns == docs.columns and keys(single) == want

    apart = common.materialize(stages["ngram_jaccard_join"](spark, single, sf))
    sets = {r: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in want.elements() for w in [words(ascii_lower(r[1]))]}
    gone = {r for r in sets for o in sets if r != o and 100 * len(sets[r] & sets[o]) >= 75 * len(sets[r] | sets[o]) and (o[0] is None, o[0] or 0) < (r[0] is None, r[0] or 0)}
    want = Counter(r for r in want.elements() if r not in gone)
    assert gone and apart.columns == docs.columns and keys(apart) == want

    mixed = common.materialize(stages["source_mix"](spark, apart, sf))
    taken = Counter((r["doc_id"], r["size"], r["taken"]) for r in source_mix.taken_words(apart, weights=(3, 1, 2), share=1.5, most=2).collect() if r["taken"])
    before = {(i, s, t) for i, t, s in want}
    sizes = Counter()
    for r in mixed.collect():
        own = [t for i, s, t in before if (i, s) == (r["doc_id"], r["source"]) and not Counter(words(r["text"])) - Counter(words(t) * 2)]
        assert len(own) >= 1 and r["n_chars"] == len(r["text"])
        sizes[r["doc_id"], len(words(own[0])), len(words(r["text"]))] += 1
    assert mixed.columns == docs.columns and sizes == taken

    plain, got = Tokenizer.from_file(queries.tokenizer_files()[0]), stages["packing"](spark, mixed, sf).collect()
    ids = Counter((r["doc_id"], tuple([*plain.encode(r["text"], add_special_tokens=False).ids, 0])) for r in mixed.collect())
    whole = Counter((i, 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids.elements() if len(x) <= 1024)
    assert not whole - Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) and sum(r["length"] for r in got) == sum(len(x) for _, x in ids.elements())
    assert corpus_pipeline.run(spark, sf).count() == len(got)


def test_substring_dedup_in_small_blocks(spark, docs):
    """Blocks far smaller than the groups in them: dealt again by longer seeds, to whole windows. The same words go."""
    want = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect())
    got = substring_dedup.remove_repeats(docs, block_words=100, limit=150, seeds=(3, 9)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == want


def test_substring_dedup_takes_the_longest_match(spark):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    long = text(300)
    rows = [(0, " ".join(long)), (1, " ".join(text(20) + long[:40] + text(20))), (2, " ".join(text(10) + long[:250] + text(30) + long[200:300])), (3, " ".join(text(400)))]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    factors = list(zip(got[2]["start"], got[2]["words"], got[2]["ref_doc"], got[2]["ref_start"]))
    assert sum(n for _, n, d, b in factors if d == 0) >= 300 and max(n for _, n, d, _ in factors if d == 0) >= 200 and len(factors) <= 8, factors
    assert {i for a, n, *_ in factors for i in range(a, a + n)} == {*range(10, 260), *range(290, 390)}
    assert got[3]["n_removed"] == 0 and got[3]["start"] is None and got[1]["n_removed"] == 40


def test_substring_dedup_deals_copies_evenly(spark):
    """A third of all rows are one text under many doc_ids: their factors go to many buckets, their words to a block once a task."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"v{rng.randint(0, 3000)}" for _ in range(n))
    one = text(400)
    table = spark.createDataFrame([(i, one if i % 3 == 0 else text(400)) for i in range(600)], "doc_id long, text string").repartition(4).withColumn("text_hash", F.xxhash64("text"))
    rows = table.mapInArrow(substring_dedup._deal(35, 5, 64, substring_dedup._of_documents), substring_dedup.ROW)
    found = rows.groupBy("kind", "bucket").agg(F.sum(F.octet_length("pos") / 4).alias("n")).collect()
    factors = [r["n"] for r in found if r["kind"] == substring_dedup.FACTOR]
    assert len(factors) > 50 and max(factors) < sum(factors) / 8
    segments = [r["n"] for r in found if r["kind"] == substring_dedup.SEGMENT]
    assert sum(segments) < 12_500 and max(segments) < sum(segments) / 8  # 400 texts and one a task, not 600


def test_narrowed_numbers_come_back():
    for largest in (0, 255, 256, 65_535, 65_536, 2**31 - 1):
        parts = [np.array([0, largest, 1], np.int32), np.array([largest], np.int32), np.zeros(0, np.int32)]
        batch = pa.RecordBatch.from_arrays([common.narrow(parts), common.binary(x.astype(np.int64) for x in parts)], names=["n", "node"])
        got = common.widen([batch, batch.slice(1)], "n", "node")
        assert got.dtype == np.int32 and got.tolist() == [0, largest, 1, largest, largest]
    assert common.widen([], "n", "node").tolist() == []
