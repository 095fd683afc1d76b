import json
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from refaudit.functions import text
from refaudit.operators import lookup, merge, overlap, ranking, report, scoring, similarity
from refaudit.sources import adapters, bibtex

PAIR = "original struct<title: string, author: string, year: string, doi: string>, candidate struct<title: string, author: string, year: string, doi: string>"


def score(spark, o, c, exact=True):
    r = scoring.assess(spark.createDataFrame([(o, c)], PAIR), exact=exact).first()
    return r["status"], r["score"], r["signals"]


@pytest.mark.parametrize(
    "o, c, status",
    [
        (("Reliable records", "Ada Lovelace and Turing, Alan", "2024", None), ("Reliable Records", "Alan Turing and Lovelace, Ada", "2024", None), "matched"),
        (("One thing", None, None, "10.1000/x"), ("Quite another matter", None, None, "10.1000/X"), "identifier_conflict"),
        (("Same title here", None, None, "10.1000/x"), ("Same title here", None, None, "10.1000/y"), "identifier_conflict"),
        ((None, None, None, "10.1000/x"), ("Some title", None, None, "10.1000/x"), "matched"),
        (("Same title here", None, None, None), ("Same title here", None, None, None), "ambiguous"),
        (("Same title here", "A Other", "1990", None), ("Same title here", "B Else", "2024", None), "no_match"),
        ((None, None, None, None), (None, None, None, None), "no_match"),
    ],
)
def test_assess(spark, o, c, status):
    assert score(spark, o, c)[0] == status


def test_weights_are_renormalized_over_known_signals(spark):
    status, s, signals = score(spark, ("Same title here", "A Other", "1990", None), ("Same title here", "B Else", "2024", None))
    assert s == pytest.approx(0.55 / 0.85) and signals["venue"] is None and signals["authors"] == 0


def test_threshold_order():
    with pytest.raises(ValueError):
        scoring.assess(None, matched=0.5, ambiguous=0.6)


def test_short_title_is_not_contained(spark):
    df = spark.createDataFrame([("ai", "a survey of explainable ai systems")], "a string, b string")
    assert df.select(similarity.title(F.col("a"), F.col("b")).alias("s")).first()["s"] < 0.68


def test_families(spark):
    df = spark.createDataFrame([("Ada Lovelace and Turing, Alan; H. Öz and ",), (None,), ("",)], "a string")
    got = [sorted(r[0]) for r in df.select(similarity.families(F.col("a"))).collect()]
    assert got == [["lovelace", "turing", "öz"], [], []]


def test_merge_decisions(spark):
    df = spark.createDataFrame([(1, "Old", "", "10.1/a", "A", "New", "J", "10.1/b", "a")], "id int, t string, j string, d string, v string, t2 string, j2 string, d2 string, v2 string")
    o = {"title": F.col("t"), "journal": F.col("j"), "doi": F.col("d"), "author": F.col("v")}
    c = {"title": F.col("t2"), "journal": F.col("j2"), "doi": F.col("d2"), "author": F.col("v2")}
    act = lambda conf: {r["field"]: r["action"] for r in merge.decisions(df, ["id"], o, c, F.lit(conf)).collect()}
    assert act(0.98) == {"title": "update", "journal": "add", "doi": "manual_review", "author": "keep_original"}
    assert act(0.80) == {"title": "suggest", "journal": "suggest", "doi": "manual_review", "author": "keep_original"}
    m = merge.merged(merge.decisions(df, ["id"], o, c, F.lit(0.98)), ["id"]).first()
    assert m["changes"] == {"title": "New", "journal": "J"} and m["n_applied"] == 2 and m["n_meaningful"] == 3


def test_same_doi_in_another_form_is_kept(spark):
    df = spark.createDataFrame([(1, "https://doi.org/10.1/A", "10.1/a")], "id int, a string, b string")
    r = merge.decisions(df, ["id"], {"doi": F.col("a")}, {"doi": F.col("b")}, F.lit(0.99)).first()
    assert r["action"] == "keep_original" or r["normalized_equal"] is False  # too short for a DOI shape: kept as text


def test_differences_take_both_sides(spark):
    a = spark.createDataFrame([(1, "title", "{A}"), (1, "note", "x")], "id int, field string, value string")
    b = spark.createDataFrame([(1, "title", "a"), (1, "year", "2000")], "id int, field string, value string")
    assert {r["field"] for r in merge.differences(a, b, ["id"]).collect()} == {"note", "year"}


def test_rank_sources(spark):
    on = [(n, i, n in {"openalex", "semantic_scholar", "pubmed", "crossref", "arxiv", "dblp", "europe_pmc"}) for i, n in enumerate(["openalex", "semantic_scholar", "pubmed", "crossref", "arxiv", "dblp", "europe_pmc"])]
    e = spark.createDataFrame([(1, "10.1/x", "5", "arXiv", "IEEE Conference on Bioinformatics"), (2, None, None, None, None)], "id int, doi string, pmid string, archiveprefix string, booktitle string")
    r = ranking.rank_sources(e, {c: F.col(c) for c in ("doi", "pmid", "archiveprefix", "booktitle")}, "id", ranking.sources(spark, on))
    got = lambda i: [x["source"] for x in r.where(F.col("id") == i).orderBy("rank").collect()]
    assert got(1)[:5] == ["crossref", "arxiv", "pubmed", "europe_pmc", "dblp"]
    assert got(2) == [n for n, _, _ in on]


def test_select_margin_conflict_and_order(spark):
    rows = [("a", "matched", 0.95, 1), ("a", "matched", 0.93, 2), ("b", "matched", 0.95, 1), ("b", "ambiguous", 0.70, 2), ("c", "matched", 0.99, 1), ("c", "identifier_conflict", 0.0, 2), ("d", "no_match", 0.1, 1)]
    got = {r["e"]: (r["source_status"], r["cand_pos"]) for r in ranking.select(spark.createDataFrame(rows, "e string, status string, score double, cand_pos int"), ["e"]).collect()}
    assert got == {"a": ("ambiguous", 1), "b": ("matched", 1), "c": ("identifier_conflict", 2), "d": ("no_match", None)}


def test_early_stop_and_outcomes(spark):
    rows = [(1, "x", 1, "no_match", None), (1, "y", 2, "matched", 0.9), (1, "z", 3, "identifier_conflict", 0.0), (2, "x", 1, "network_error", None), (2, "y", 2, "no_match", None), (3, "x", 1, "skipped", None)]
    r = spark.createDataFrame(rows, "e int, source string, rank int, source_status string, score double")
    walked = ranking.consulted(r, "e")
    assert walked.where("e = 1").count() == 2 and ranking.consulted(r, "e", stop_on_match=False).where("e = 1").count() == 3
    out = {x["e"]: (x["status"], x["source"], x["complete"]) for x in ranking.outcomes(walked, "e").collect()}
    assert out == {1: ("verified", "y", True), 2: ("source_unavailable", None, False), 3: ("invalid_input", None, False)}


def test_duplicate_and_missing_keys(spark):
    e = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (" ",)], "key string")
    assert [r["key"] for r in report.valid_keys(e, "key").collect()] == ["b"]


def test_metrics_on_empty_input(spark):
    r = report.metrics(spark.createDataFrame([], "expected string, predicted string")).first()
    assert r["cases"] == 0 and r["accuracy"] == 0 and r["match_precision"] == 0


def test_title_lookup_is_limited_and_ordered(spark):
    e = spark.createDataFrame([(1, "deep learning for bees"), (2, "")], "id int, t string")
    r = spark.createDataFrame([(i, f"deep learning for bees part {i}") for i in range(9)] + [(100, "deep learning for bees"), (101, "other")], "rid int, rt string")
    got = lookup.by_title(e, r, "id", "rid", F.col("t"), F.col("rt")).orderBy("rank").collect()
    assert got[0]["rid"] == 100 and len(got) == 5 and {g["id"] for g in got} == {1}


def test_title_lookup_is_exact_whatever_the_words(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    records = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 7)))) for i in range(3_000)] + [(3_000, "r1 r2 r3 r4"), (3_001, "r1 r2 r3"), (3_002, "")]
    entries = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 7)))) for i in range(40)] + [(40, "w0 w1 w2 w3 r1 r2 r3"), (41, "nowhere"), (42, " "), (43, "w0 w1 w2 w3 w4 nowhere")]
    got = lookup.by_title(spark.createDataFrame(entries, "id int, t string"), spark.createDataFrame(records, "rid int, rt string"), "id", "rid", F.col("t"), F.col("rt"))
    want = []
    for i, t in entries:
        a = set(t.split())
        near = sorted((-len(a & b) / len(a | b), r, len(a & b)) for r, x in records if a & (b := set(x.split())))
        want += [(i, r, n, k) for k, (_, r, n) in enumerate(near[:5], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("block", [250_000, 60])
def test_title_lookup_leaves_out_what_cannot_match(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(lookup, "BLOCK", block)
    rng = random.Random(7)
    title = lambda: " ".join(rng.choice([f"w{i}" for i in range(30)]) for _ in range(rng.randint(3, 9)))
    entries, records = [(i, title(), rng.choice([0.0, 0.5, 0.8])) for i in range(60)], [(i, title()) for i in range(300)]
    got = lookup.by_title(spark.createDataFrame(entries, "id int, t string, n double"), spark.createDataFrame(records, "rid int, rt string"), "id", "rid", F.col("t"), F.col("rt"), least=F.col("n"))
    want, left_out = [], 0
    for i, t, n in entries:
        a = set(t.split())
        near = sorted((-len(a & b) / len(a | b), r, len(a & b), len(b)) for r, x in records if a & (b := set(x.split())))[:5]
        kept = [(i, r, s, k) for k, (share, r, s, m) in enumerate(near, 1) if -share >= n or s >= min(len(a), m) - 2]
        want, left_out = want + kept, left_out + len(near) - len(kept)
    assert sorted(map(tuple, got.collect())) == sorted(want) and left_out


def test_titles_are_counted_exactly_in_any_division(spark, monkeypatch):
    import random

    monkeypatch.setattr(lookup, "BLOCK", 60)
    monkeypatch.setattr(lookup, "PART", 9)
    monkeypatch.setattr(overlap, "SLICE", 16)
    monkeypatch.setattr(overlap, "COMMON", 4)
    rng = random.Random(5)
    title = lambda: " ".join(rng.choice(["of", "in", *[f"w{i}" for i in range(20)]]) for _ in range(rng.randint(1, 9)))
    entries, records = [(("a", i), title()) for i in range(40)], [(f"r{i}", title()) for i in range(200)] * 2
    records = [(f"{k}-{i % 7}", t) for i, (k, t) in enumerate(records)]
    got = lookup.by_title(spark.createDataFrame(entries, "id struct<path: string, pos: int>, t string"), spark.createDataFrame(records, "rid string, rt string"), "id", "rid", F.col("t"), F.col("rt"))
    want = []
    for i, t in entries:
        a = set(t.split())
        near = sorted((-len(a & b) / len(a | b), r, len(a & b)) for r, x in records if a & (b := set(x.split())))
        want += [(i, r, n, k) for k, (_, r, n) in enumerate(near[:5], 1)]
    assert sorted((tuple(g["id"]), g["rid"], g["shared"], g["rank"]) for g in got.collect()) == sorted(want)


def test_title_slices_match_brute_force(monkeypatch):
    import random

    import pyarrow as pa

    rng = random.Random(7)
    for size, common in ((7, 2), (64, 10), (1 << 16, 512)):
        titles = lambda n: pa.array(list(dict.fromkeys(" ".join(sorted({f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 9))})) for _ in range(n))))
        e, r = titles(40), titles(400)
        monkeypatch.setattr(overlap, "SLICE", size)
        monkeypatch.setattr(overlap, "COMMON", common)
        got = [x.tolist() for x in overlap.closest(e, r, pa.array(range(len(r), 0, -1)), 5)]
        want = []
        for i, t in enumerate(e.to_pylist()):
            a = set(t.split())
            near = sorted((-len(a & b) / len(a | b), -j, len(a & b)) for j, x in enumerate(r.to_pylist()) if a & (b := set(x.split())))
            want += [(i, -j, n) for _, j, n in near[:5]]
        assert list(zip(*got)) == want


def test_cache(spark):
    log = spark.createDataFrame([("k", 1.0, "a"), ("k", 5.0, "b"), ("m", 0.0, "c")], "cache_key string, created double, body string")
    state = lookup.latest(log, "cache_key", ["created"])
    hits = {r["cache_key"]: (r["hit"], r["body"]) for r in lookup.cached(spark.createDataFrame([("k",), ("m",), ("z",)], "cache_key string"), state, F.lit(10.0), 5.0).collect()}
    assert hits == {"k": (True, "b"), "m": (False, None), "z": (False, None)}


def test_bibtex_scanner():
    src = '@comment{x} @string{j = {J of Y}}\n@article{k1, title={{A {B} c}}, author = "X and Y", journal = j # { Z}, month = jan}\njunk @book(k2, title = {q}) @misc{k3'
    got = bibtex.parse(src)
    assert [e["key"] for e in got] == ["k1", "k2", "k3"]
    assert dict(got[0]["fields"]) == {"title": "{A {B} c}", "author": "X and Y", "journal": "J of Y Z", "month": "January"}
    assert bibtex.parse(None) == [] and bibtex.parse("") == []


def test_bibtex_files_and_round_trip(spark, tmp_path):
    (tmp_path / "a.bib").write_bytes("@article{k,\r\n title = {Größe},\r\n x_custom = {7}\r\n}\r\n".encode("utf-8-sig"))
    r = bibtex.read_files(spark, str(tmp_path / "a.bib"))
    row = r.first()
    assert row["newline"] == "\r\n" and row["fields"] == {"title": "Größe", "x_custom": "7"}
    out = r.select(bibtex.serialize(F.col("key"), F.col("entrytype"), {"title": F.col("fields")["title"]}, F.map_filter("fields", lambda k, v: k != "title")).alias("t")).first()["t"]
    assert dict(bibtex.parse(out)[0]["fields"]) == row["fields"]


def test_adapters_survive_missing_parts(spark):
    df = spark.createDataFrame([Row(id=1, payload="{}"), Row(id=2, payload="no json"), Row(id=3, payload=None), Row(id=4, payload=json.dumps({"title": "T", "authors": {"author": {"text": "A B"}}, "pages": "1-2"}))])
    got = {r["id"]: r for r in adapters.adapt_json(df, "dblp", ["id"]).collect()}
    assert got[1]["title"] is None and got[4]["author"] == "A B" and got[4]["pages"] == "1--2" and got[4]["title"] == "{T}"


def test_arxiv_never_makes_up_a_doi(spark):
    xml = "<entry xmlns='http://www.w3.org/2005/Atom'><id>http://arxiv.org/abs/2601.00001v1</id><published>2026-01-01T00:00:00Z</published><title>A\n b</title><author><name>Ada L</name></author></entry>"
    r = adapters.adapt_atom(spark.createDataFrame([(1, xml)], "id int, payload string"), ["id"]).first()
    assert r["doi"] is None and r["eprint"] == "2601.00001v1" and r["title"] == "{A  b}" and r["author"] == "Ada L"


def test_normalizers_agree_on_plain_text(spark):
    df = spark.createDataFrame([("A-b, C_d  {E}",), ("Über β x",), (None,)], "t string")
    assert all(r[0] == r[1] for r in df.select(text.normalize("t"), text.normalize_native("t")).collect())


@pytest.mark.parametrize("exact", [True, False])
def test_pairs_are_scored_on_forms_made_before_they_meet(spark, exact):
    sides = [
        ({"title": "{Deep} Learning for Bees!", "author": "Lovelace, Ada and Alan Turing", "year": "in 2020", "doi": "https://doi.org/10.1/X"}, {"title": "Deep learning for bees", "author": "A. Lovelace; A. Turing", "year": "2021", "doi": "10.1/x"}),
        ({"title": "Deep learning for bees", "author": "", "year": "", "doi": "10.1/x"}, {"title": "Deep learning for wasps", "author": "Hopper, Grace", "year": "2021", "doi": "10.1/y"}),
        ({"title": "", "author": None, "year": None, "doi": None}, {"title": "Other", "author": "Hopper, Grace", "year": "2021", "doi": None}),
    ]
    pair = "struct<title: string, author: string, year: string, doi: string>"
    pairs = spark.createDataFrame([(i, o, c) for i, (o, c) in enumerate(sides)], f"id int, original {pair}, candidate {pair}")
    want = {r["id"]: r for r in scoring.assess(pairs, exact=exact).select("id", "score", "status", "signals").collect()}
    assert [want[i]["status"] for i in range(3)] == ["matched", "identifier_conflict", "no_match"]
    made = [scoring.with_forms(pairs.select("id", s), s, f"_{s}", exact).select("id", f"_{s}").localCheckpoint() for s in ("original", "candidate")]
    scored = scoring.assess(made[0].join(made[1], "id"), exact=exact)
    assert {r["id"]: r for r in scored.select("id", "score", "status", "signals").collect()} == want and scored.columns == ["id", "score", "status", "signals", "reason"]
    assert "regexp" not in scored._jdf.queryExecution().optimizedPlan().toString()  # a pair normalizes nothing


def test_the_words_of_a_pair_are_made_and_met_once(spark):
    side = lambda t: (t, "Ada Lovelace and Bo Ek")
    pairs = spark.createDataFrame([(side("Deep learning for bees"), side("Learning for bees: deep or not"))], "original struct<title: string, author: string>, candidate struct<title: string, author: string>")
    for s in ("original", "candidate"):
        pairs = scoring.with_forms(pairs, s, f"_{s}", exact=False)
    pairs = pairs.select("_original", "_candidate").localCheckpoint()
    scored = scoring.assess(pairs, exact=False).select("status", "score")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(_(?:original|candidate)#\d+\.t,", plan)) == 2
    assert len(re.findall(r"array_intersect\(_original#\d+\.a,", plan)) == 1
    assert scored.first()["score"] == pytest.approx((0.55 * 4 / 6 + 0.2) / 0.75)
