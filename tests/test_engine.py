from pyspark.sql import functions as F

from refaudit import config
from refaudit.operators import report, scoring
from refaudit.plans.engine import FIELDS, Engine, Settings
from refaudit.session import read
from refaudit.streaming import verify as streaming

D = "/root/testdata/sf0.001"
CROSSREF = "rec_id bigint, work_type string, title array<string>, author array<struct<given: string, family: string>>, published struct<`date-parts`: array<array<int>>>, published_print struct<`date-parts`: array<array<int>>>, container_title array<string>, volume string, issue string, page string, publisher string, doi string"


def records(spark):
    row = lambda i, t, doi: (i, "journal-article", [t], [("Ada", "Lovelace")], ([[2026]],), None, ["Journal of Metadata"], "1", None, "1-9", None, doi)
    return spark.createDataFrame([row(1, "Reliable Bibliographic Verification", "10.1000/reliable"), row(2, "Another topic", "10.1000/other")], CROSSREF)


BIB = """@article{a, title = {Reliable Bibliographic Verification}, author = {Lovelace, Ada}, year = {2025}, doi = {https://doi.org/10.1000/reliable}, x_custom = {keep}}
@article{b, title = {Unrelated Quantum Gravity Paper}, doi = {10.1000/reliable}}
@article{c, title = {Reliable bibliographic verification}, author = {Ada Lovelace}, year = {2026}}
@article{d, title = {Nothing like it exists}}
@article{e, title = {x}}
@article{e, title = {y}}
"""


def test_verify_a_file(spark, tmp_path):
    (tmp_path / "refs.bib").write_text(BIB)
    engine = Engine(spark)
    entries = engine.entries(str(tmp_path / "refs.bib"))
    assert entries.where("key = 'a'").first()["extra"] == {"x_custom": "keep"}
    got = {(r["key"], r["pos"]): r for r in engine.verify(entries, {"crossref": records(spark)}).collect()}
    assert len(got) == 6
    assert got["a", 0]["bucket"] == "updated" and got["a", 0]["status"] == "metadata_mismatch" and got["a", 0]["changes"]["year"] == "2026" and "doi" not in got["a", 0]["changes"]
    assert got["b", 1]["bucket"] == "identifier_conflict"
    assert got["c", 2]["status"] == "metadata_mismatch" and got["c", 2]["changes"]["doi"] == "10.1000/reliable"
    assert got["d", 3]["bucket"] == "not_found"
    assert {got["e", 4]["bucket"], got["e", 5]["bucket"]} == {"invalid_input"}


def test_doi_to_bibtex(spark):
    out = Engine(spark).doi_to_bibtex("https://doi.org/10.1000/RELIABLE", records(spark)).first()[0]
    assert Engine(spark).doi_to_bibtex("doi:10.1000/reliable", records(spark), "own").first()[0].startswith("@article{own,")
    assert out.startswith("@article{Lovelace2026Reliable,\n  title = {{Reliable Bibliographic Verification}}") and "pages = {1--9}" in out


def test_settings_are_checked():
    import pytest

    with pytest.raises(ValueError):
        Settings(matched=1.5)
    with pytest.raises(ValueError):
        Settings(matched=0.5, ambiguous=0.6)


def test_stream_of_entries(spark, tmp_path):
    engine = Engine(spark)
    (tmp_path / "refs.bib").write_text(BIB)
    e = engine.entries(str(tmp_path / "refs.bib"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = streaming.verify_stream(stream, engine, lambda: {"crossref": records(spark)}, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_plans_have_no_cartesian_and_prune_columns(spark):
    from refaudit.plans import queries

    for name in ("j_exact", "j_cascade", "j_title_top", "r_rank_sources", "m_assess", "d_differences"):
        plan = queries.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = queries.queries()["j_exact"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "container_title" not in plan


def test_field_list_is_complete():
    assert {"title", "author", "doi", "pages"} <= set(FIELDS)


def test_all_queries_run_on_the_small_tables(spark):
    from refaudit.plans import queries

    for name in ("a_crossref", "a_openalex", "a_semantic_scholar", "a_europe_pmc", "g_outcomes", "w_select", "k_serialize"):
        df = queries.queries()[name](spark, D)
        assert df.count() > 0 and len(df.columns) == len(set(df.columns))
    assert read(spark, D, "cases").where(F.col("case_id").isNotNull()).count() > 0


def test_apply_keeps_custom_fields_and_bytes(spark, tmp_path):
    path = tmp_path / "refs.bib"
    path.write_bytes(BIB.replace("\n", "\r\n").encode())
    before = path.read_bytes()
    engine = Engine(spark)
    entries = engine.entries(str(path)).drop("path").cache()
    entries.count()
    results = engine.verify(entries, {"crossref": records(spark)}).cache()
    assert engine.apply(str(path), entries, results)
    assert (tmp_path / "refs.bib.bak").read_bytes() == before
    after = path.read_bytes()
    assert b"x_custom = {keep}" in after and b"year = {2026}" in after and not after.startswith(b"\xef\xbb\xbf") and after.count(b"\r\n") == after.count(b"\n")
    review = engine.review(entries, results).orderBy("bucket_ord", "pos").collect()
    assert [r["bibtex"].split("{")[1].split(",")[0] for r in review] == ["d", "b", "e", "e"]
    s = report.summary(results).first()
    assert s["counts"]["total"] == 6 and s["counts"]["invalid_input"] == 2 and s["complete"] is False


def test_labelled_pairs(spark, tmp_path):
    (tmp_path / "pairs.json").write_text('[{"id": "a", "expected": "matched", "original": {"title": "T", "year": "2000"}, "candidate": {"title": "T", "year": "2000"}}]')
    pairs = Engine(spark).labelled_pairs(str(tmp_path / "pairs.json"))
    assert scoring.assess(pairs).first()["status"] == "matched"


def test_config(tmp_path):
    import json

    import pytest

    (tmp_path / "c.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"query_settings": {"match_threshold": 0.9, "timeout": 5}, "output_settings": {"generate_wrong_bib": False}, "bib_file": "a/r.bib"}).encode())
    c = config.load(str(tmp_path / "c.json"), {"output_settings": {"report_format": "CSV"}, "user_info": {"email": "o"}}, {"REFAUDIT_CORE_API_KEY": "k", "REFAUDIT_EMAIL": "e"})
    q = c["query_settings"]
    assert q["match_threshold"] == 0.9 and q["ambiguous_threshold"] == 0.68 and q["read_timeout"] == 5 and c["output_settings"]["report_format"] == "csv" and c["output_settings"]["generate_review_bib"] is False
    assert c["platforms"]["core"]["api_key"] == "k" and c["user_info"]["email"] == "e" and c["bib_file"] == str(tmp_path / "a" / "r.bib") and c["output_dir"] == str(tmp_path / "a")
    s = config.to_settings(c)
    assert s.matched == 0.9 and s.keys == {"core": "k"} and ("base", 11, False) in s.sources
    explicit = config.load(None, {"query_settings": {"timeout": 5, "read_timeout": 7}}, {})
    assert explicit["query_settings"]["read_timeout"] == 7
    for bad in ({"output_settings": {"report_format": "pdf"}}, {"query_settings": {"ambiguous_threshold": 0.95}}, {"platforms": {"crossref": {"enabled": "yes"}}}, {"query_settings": {"cache_ttl_hours": -1}}, {"language": "DE"}, {"query_settings": {"connect_timeout": 0}}, {"query_settings": {"ambiguity_margin": 2}}):
        with pytest.raises(ValueError):
            config.load(None, bad, {})
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "list.json"), None, {})
    config.write_starter(str(tmp_path / "s.json"))
    with pytest.raises(FileExistsError):
        config.write_starter(str(tmp_path / "s.json"))
    assert config.within(str(tmp_path), "a/b") == str(tmp_path / "a" / "b")
    with pytest.raises(ValueError):
        config.within(str(tmp_path), "../x")


def test_two_files_keep_their_entries_apart(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@article{k, title = {Reliable Bibliographic Verification}, author = {Lovelace, Ada}, year = {2026}, doi = {10.1000/reliable}}")
    (tmp_path / "b.bib").write_text("@article{k, title = {Nothing of the kind}}\n@article{m, title = {Another topic}, author = {Lovelace, Ada}, year = {2026}}")
    engine = Engine(spark)
    entries = engine.entries(str(tmp_path))
    got = {(r["path"][-5:], r["pos"]): r["status"] for r in engine.verify(entries, {"crossref": records(spark)}).collect()}
    assert got == {("a.bib", 0): "metadata_mismatch", ("b.bib", 0): "not_found", ("b.bib", 1): "metadata_mismatch"}
    assert engine.updated(entries, engine.verify(entries, {"crossref": records(spark)})).count() == 3


def test_an_undecodable_file_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "a.bib").write_bytes(b"@article{k, title = {\xff\xff}}")
    with pytest.raises(Exception, match="encodings"):
        Engine(spark).entries(str(tmp_path)).count()


def test_entries_that_cannot_be_asked(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@misc{none, year = {2000}}\n@misc{bio, doi = {10.1101/x1}}\n@misc{t, title = {Some title of a work}}\n@misc{id, eprint = {2101.00001}}")
    engine = Engine(spark, Settings(stop_on_match=False, sources=[("biorxiv", 1, True), ("core", 2, True), ("dblp", 3, True), ("base", 4, True), ("unpaywall", 5, True)]))
    empty = spark.createDataFrame([], "rec_id bigint, payload string")
    got = {r["key"]: r for r in engine.verify(engine.entries(str(tmp_path)), {s: empty for s in ("biorxiv", "core", "dblp")}).collect()}
    seen = lambda k: {p["source"]: p["status"] for p in got[k]["providers"] or []}
    assert got["none"]["status"] == "invalid_input" and not got["none"]["complete"] and seen("none") == {}
    assert seen("bio") == {"biorxiv": "no_match", "core": "invalid_input", "dblp": "invalid_input", "base": "skipped", "unpaywall": "skipped"} and got["bio"]["status"] == "not_found"
    assert seen("t") == {"biorxiv": "skipped", "core": "auth_error", "dblp": "no_match", "base": "skipped", "unpaywall": "skipped"} and got["t"]["status"] == "source_unavailable" and not got["t"]["complete"]
    assert got["id"]["status"] == "invalid_input" and "no source" in got["id"]["reason"]


WORK = {"title": "Reliable Bibliographic Verification", "author": "Ada Lovelace", "year": "2026"}


def asked(spark, **extra):
    row = {f: "" for f in FIELDS} | WORK | extra
    return spark.createDataFrame([(0, "k", "article", *[row[f] for f in FIELDS], {})], ", ".join(["pos bigint, key string, entrytype string", *[f"{f} string" for f in FIELDS], "extra map<string,string>"]))


def replay(spark, cases):
    """Results by name of (name, source, http status, body, error, fields of the entry) in one run."""
    rows, answers = [], []
    for n, (name, source, http, body, error, extra) in enumerate(cases):
        row = {f: "" for f in FIELDS} | WORK | extra
        rows.append((n, name, "article", *[row[f] for f in FIELDS], {}))
        answers.append((n, source, http, error, body))
    entries = spark.createDataFrame(rows, ", ".join(["pos bigint, key string, entrytype string", *[f"{f} string" for f in FIELDS], "extra map<string,string>"]))
    recorded = spark.createDataFrame(answers, "pos bigint, source string, http_status int, error string, body string")
    sources = sorted({c[1] for c in cases})
    got = {}
    for r in Engine(spark, Settings(sources=[(s, i, True) for i, s in enumerate(sources)])).verify(entries, {}, recorded).collect():
        heard = [p["status"] for p in r["providers"] if p["source"] == cases[r["pos"]][1]]
        got[r["key"]] = (heard[0], r)
    return got


def test_recorded_answers_of_the_sources(spark):
    import json

    t = WORK["title"]
    crossref = {"type": "journal-article", "title": [t], "author": [{"given": "Ada", "family": "Lovelace"}], "published": {"date-parts": [[2026]]}, "container-title": ["Journal of Metadata"], "page": "1-9", "DOI": "10.1000/reliable"}
    bodies = {
        "crossref": {"message": {"items": [crossref, 7]}}, "openalex": {"results": [{"title": t, "publication_year": 2026, "authorships": [{"author": {"display_name": "Ada Lovelace"}}], "biblio": {"first_page": "1", "last_page": "9"}}]},
        "semantic_scholar": {"data": [{"title": t, "year": 2026, "authors": [{"name": "Ada Lovelace"}], "externalIds": {"DOI": "10.1000/reliable", "PubMed": "12345678"}}]},
        "europe_pmc": {"resultList": {"result": [{"title": t, "authorString": "Lovelace A", "pubYear": "2026", "pmcid": "PMC123"}]}},
        "dblp": {"result": {"hits": {"hit": [{"info": {"title": t, "year": "2026", "authors": {"author": {"text": "Ada Lovelace"}}}}]}}},
        "pubmed": {"result": {"uids": ["12345678"], "12345678": {"uid": "12345678", "title": t, "pubdate": "2026 Jan", "authors": [{"name": "Lovelace A"}], "articleids": [{"idtype": "pubmed", "value": "12345678"}]}}},
        "biorxiv": {"collection": [{"title": t, "authors": "Ada Lovelace; Alan Turing", "date": "2026-01-01", "doi": "10.1101/2026.01.01.123456", "version": "2"}]},
    }
    more = {"europe_pmc": {"pmcid": "PMC123"}, "pubmed": {"pmid": "12345678"}, "biorxiv": {"doi": "10.1101/2026.01.01.123456"}}
    cases = [(s, s, 200, json.dumps(b), None, more.get(s, {})) for s, b in bodies.items()]
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/2601.00001v1</id><published>2026-01-01T00:00:00Z</published><title>Reliable Bibliographic Verification</title><author><name>Ada Lovelace</name></author></entry></feed>"
    one, doi = json.dumps({"message": crossref}), {"doi": "10.1000/reliable"}
    cases += [("arxiv", "arxiv", 200, atom, None, {"eprint": "2601.00001", "archiveprefix": "arXiv"}), ("exact", "crossref", 200, one, None, doi), ("other title", "crossref", 200, one, None, doi | {"title": "Unrelated Quantum Gravity Paper"})]
    cases += [(str(h), "openalex", h, "", None, {}) for h in (404, 429, 401, 500)]
    cases += [("html", "openalex", 200, "<html>", None, {}), ("list", "openalex", 200, "[1]", None, {}), ("no feed", "arxiv", 200, "no feed", None, {}), ("timeout", "openalex", None, None, "timeout", {}), ("empty", "openalex", 200, '{"results": []}', None, {})]
    got = replay(spark, cases)
    assert {k: v[0] for k, v in got.items()} == {s: "matched" for s in (*bodies, "arxiv", "exact")} | {
        "other title": "identifier_conflict", "404": "no_match", "429": "rate_limited", "401": "auth_error", "500": "provider_error", "html": "parse_error", "list": "parse_error", "no feed": "parse_error", "timeout": "network_error", "empty": "no_match",
    }
    assert got["openalex"][1]["changes"]["pages"] == "1--9" and got["other title"][1]["bucket"] == "identifier_conflict"
    assert got["timeout"][1]["bucket"] == "source_unavailable" and not got["timeout"][1]["complete"] and got["404"][1]["bucket"] == "not_found" and got["404"][1]["complete"]


def test_reports(spark, tmp_path):
    import csv
    import json

    (tmp_path / "refs.bib").write_text(BIB)
    engine = Engine(spark)
    results = engine.verify(engine.entries(str(tmp_path / "refs.bib")), {"crossref": records(spark)}).cache()
    text_of = lambda form, lang="EN": [r["value"] for r in report.lines(results, form, lang, {"input": "refs.bib"}).orderBy("part", "at").collect()]
    doc = json.loads("\n".join(text_of("json")))
    assert doc["counts"]["total"] == 6 and [e["key"] for e in doc["entries"]] == ["a", "c", "d", "b", "e", "e"] and doc["complete"] is False and doc["input"] == "refs.bib"
    assert {d["field"] for d in doc["entries"][0]["field_diffs"] if d["action"] == "update"} >= {"year"} and doc["entries"][0]["differences"]["year"]["original"] == "2025"
    lines = [json.loads(x) for x in text_of("jsonl")]
    assert [x["type"] for x in lines] == ["summary", *["entry"] * 6] and lines[0]["counts"]["invalid_input"] == 2
    rows = list(csv.DictReader("\n".join(text_of("csv")).splitlines()))
    assert len(rows) == 6 and list(rows[0]) == list(report.CSV_COLUMNS) and rows[0]["status"] == "metadata_mismatch" and rows[-1]["status"] == ""
    shown = "\n".join(text_of("txt"))
    assert "Complete: no" in shown and "  total: 6" in shown and "- a: metadata_mismatch" in shown and "  year: update (crossref, " in shown and "- e: unknown" in shown
    assert "核查完整: 否" in "\n".join(text_of("txt", "CN"))
    for form in ("csv", "json", "jsonl", "txt"):
        report.write(results, str(tmp_path / form), form)
        parts = sorted(p for p in (tmp_path / form).iterdir() if p.suffix == ".txt")
        assert "\n".join(x for p in parts for x in p.read_text().splitlines()) == "\n".join(report_lines(results, form))
    none = results.limit(0)
    assert json.loads("\n".join(r["value"] for r in report.lines(none, "json").orderBy("part", "at").collect()))["entries"] == []


def report_lines(results, form):
    return "\n".join(r["value"] for r in report.lines(results, form).orderBy("part", "at").collect()).splitlines()


def test_prepared_sources_and_explain_and_first_match(spark, tmp_path):
    (tmp_path / "refs.bib").write_text(BIB)
    engine = Engine(spark)
    entries = engine.entries(str(tmp_path / "refs.bib"))
    engine.prepare(records(spark), "crossref").write.parquet(str(tmp_path / "crossref"))
    stored = spark.read.parquet(str(tmp_path / "crossref"))
    shown = lambda t: sorted((r["pos"], r["bucket"], r["confidence"]) for r in engine.verify(entries, {"crossref": t}).collect())
    assert shown(stored) == shown(records(spark))
    got = {r["pos"]: (r["source"], r["candidate"]["doi"]) for r in engine.first_match(entries, {"crossref": records(spark)}).collect()}
    assert got[0] == ("crossref", "10.1000/reliable") and got[1] == ("crossref", "10.1000/reliable") and 3 not in got
    a = spark.createDataFrame([(1, "{A}", "x")], "pos bigint, title string, note string")
    b = spark.createDataFrame([(1, "a", "2000")], "pos bigint, title string, year string")
    assert {r["field"] for r in engine.explain(a, b, ["pos"]).collect()} == {"note", "year"}


def test_candidates_that_cannot_match_are_left_out(spark, monkeypatch):
    engine = Engine(spark, Settings(exact=False))
    e = asked(spark, title="Reliable Verification of Numbers", doi="")
    few = spark.createDataFrame([(i, "journal-article", [t], None, None, None, None, "1", None, "1-9", None, "10.1/x") for i, t in enumerate(["Numbers for everyone elsewhere and their friends", "Reliable verification of numbers"])], CROSSREF)
    found = lambda x: sorted(r["cand_pos"] for r in engine.candidates(engine.asked(engine.named(x), "crossref"), "crossref", few).collect())
    assert found(e) == [1] and found(asked(spark, title="Reliable Verification of Numbers", doi="10.1/y")) == [0, 1]  # a DOI may differ
    got = engine.verify(e, {"crossref": few}).collect()
    monkeypatch.setattr(scoring, "least_title", lambda *_: F.lit(0.0))
    assert found(e) == [0, 1] and engine.verify(e, {"crossref": few}).collect() == got


def test_a_source_can_be_registered(spark):
    from refaudit.sources import adapters

    adapters.register("shelf", lambda r, native=False: {"ENTRYTYPE": F.lit("book"), "title": r("name")}, ddl="name STRING")
    try:
        df = spark.createDataFrame([(1, '{"name": "Reliable Bibliographic Verification"}')], "rec_id bigint, payload string")
        r = Engine(spark, Settings(sources=[("shelf", 1, True)])).verify(asked(spark, author="", year=""), {"shelf": df}).first()
        assert r["status"] == "ambiguous"  # nothing but the titles agree
    finally:
        del adapters.ADAPTERS["shelf"], adapters.ACCESS["shelf"], adapters.DDL["shelf"]


def test_first_entry_of_a_text(spark):
    from refaudit.sources import bibtex

    df = spark.createDataFrame([(1, "@inproceedings{k,\n title={{A {B}}},\n year={2000}\n}\n@misc{m, title={z}}"), (2, "none"), (3, None), (4, "@book{q, title = {{C}}, author = {D}}")], "id int, text string")
    got = {r["id"]: (r["ENTRYTYPE"], r["fields"]) for r in bibtex.first_entry(df, ["id"]).collect()}
    assert got == {1: ("inproceedings", {"title": "{A {B}", "year": "{2000}"}), 2: ("misc", {}), 3: ("misc", {}), 4: ("book", {"title": "{C}", "author": "{D}"})} or got[1][1]["title"] == "{A {B}}"
