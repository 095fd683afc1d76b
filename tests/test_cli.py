import json

from refaudit.__main__ import main

D = "/root/testdata/sf0.001"


def test_sources(capsys):
    assert main(["sources"]) == 0
    out = capsys.readouterr().out
    assert out.splitlines()[0].split() == ["1", "crossref"] and "unpaywall (off) (no adapter)" in out


def test_evaluate(spark, capsys):
    code = main(["evaluate", "--tables", D])
    m = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert m["cases"] > 0 and 0 <= m["accuracy"] <= 1 and code == int(m["wrong_auto_match_rate"] > 0)


def test_doi_not_found(spark, capsys):
    assert main(["doi", "10.1/none", "--tables", D]) == 1
    assert capsys.readouterr().out == "not found"


LIST = "@article{a, title = {Nothing that any source knows of}}\n@article{a, title = {x}}\n"


def test_check_writes_a_report(spark, tmp_path, capsys):
    (tmp_path / "a.bib").write_text(LIST)
    args = ["check", str(tmp_path / "a.bib"), "--config", str(tmp_path / "none.json"), "--tables", D, "--output-dir", str(tmp_path / "out")]
    code = main([*args, "--format", "csv", "--json"])
    shown = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert code == 5 and shown["counts"]["invalid_input"] == 2 and shown["counts"]["total"] == 2 and not shown["applied"] and not shown["complete"]
    assert {p.suffix for p in (tmp_path / "out").iterdir()} == {".csv", ".bib"} and shown["files"]["review"] and shown["files"]["updated"] is None
    before = (tmp_path / "a.bib").read_bytes()
    assert main([*args[:-1], str(tmp_path / "dry"), "--dry-run", "--quiet"]) == 5 and not (tmp_path / "dry").exists() and capsys.readouterr().out == ""
    assert (tmp_path / "a.bib").read_bytes() == before
    assert main(["check", str(tmp_path / "missing.bib"), "--config", str(tmp_path / "none.json")]) == 5


def test_switches_of_the_settings(spark, tmp_path, capsys):
    (tmp_path / "a.bib").write_text("@article{a, title = {Nothing that any source knows of}}\n")
    (tmp_path / "c.json").write_text(json.dumps({"bib_file": "a.bib", "output_dir": "out", "output_settings": {"generate_report": True, "report_format": "jsonl", "generate_backup": False, "generate_review_bib": False}}))
    assert main(["check", "--config", str(tmp_path / "c.json"), "--tables", D]) in (2, 3)
    assert [p.suffix for p in (tmp_path / "out").iterdir()] == [".jsonl"]
    (tmp_path / "bad.json").write_text('{"language": "DE"}')
    assert main(["check", "--config", str(tmp_path / "bad.json")]) == 5


def test_small_commands(spark, tmp_path, capsys):
    assert main(["init", "--output", str(tmp_path / "c.json")]) == 0 and main(["init", "--output", str(tmp_path / "c.json")]) == 2
    assert main(["doctor", "--config", str(tmp_path / "c.json")]) == 0
    assert main(["clear-cache", "--config", str(tmp_path / "c.json")]) == 0
    capsys.readouterr()
    assert main(["rank", '{"doi": "10.1/x", "journal": "Clinical notes"}']) == 0
    assert json.loads(capsys.readouterr().out)["sources"][:3] == ["crossref", "pubmed", "europe_pmc"]
    assert main(["diff", '{"title": "{A}", "year": "1"}', '{"title": "a", "year": "2"}']) == 0
    assert json.loads(capsys.readouterr().out) == {"differences": {"year": {"original": "1", "updated": "2"}}}
