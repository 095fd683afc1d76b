import pytest
from pyspark.sql import functions as F

from refaudit.functions import identifiers as ids
from refaudit.functions import text


def one(spark, expr, **row):
    ddl = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], ddl).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("raw, form", [("https://doi.org/10.1000/XYZ.", "10.1000/xyz"), ("doi: 10.1000/a;", "10.1000/a"), ("{10.1000/B}", "10.1000/b"), ("not a doi", "not a doi"), (None, ""), ("", "")])
def test_doi(spark, raw, form):
    assert one(spark, ids.doi("x"), x=raw) == form


@pytest.mark.parametrize("raw, form", [("PMID: 123 and 4", "123"), (None, ""), ("none", "")])
def test_pmid(spark, raw, form):
    assert one(spark, ids.pmid("x"), x=raw) == form


@pytest.mark.parametrize("raw, form", [("arXiv:2401.12345v2", "2401.12345"), ("https://arxiv.org/pdf/2401.12345v1.pdf", "2401.12345"), ("hep-th/9901001", "hep-th/9901001"), ("10.1016/1234.56789", "1234.56789"), (None, "")])
def test_arxiv(spark, raw, form):
    assert one(spark, ids.arxiv("x"), x=raw) == form


def test_extraction_cascade(spark):
    df = spark.createDataFrame([("", "", "PMID: 12345678, PMC7654321 and 10.1000/ABC.", "arXiv:2401.12345v2")], "doi string, url string, note string, howpublished string")
    r = df.select(ids.extract({c: F.col(c) for c in df.columns}).alias("i")).first()["i"]
    assert (r["doi"], r["pmid"], r["pmcid"], r["arxiv"]) == ("10.1000/abc", "12345678", "PMC7654321", "2401.12345")


@pytest.mark.parametrize("url, yes", [("https://arxiv.org/abs/1", True), ("export.arxiv.org/abs/1", True), ("//arxiv.org/abs/1", True), ("https://arxiv.org.example.com/abs/1", False), ("https://example.com/?next=arxiv.org", False), (None, False), ("", False)])
def test_arxiv_host(spark, url, yes):
    assert one(spark, ids.is_arxiv_url("x"), x=url) is yes


def test_display_doi_keeps_case(spark):
    assert one(spark, ids.display_doi("x"), x="{https://doi.org/10.1000/XYZ.}") == "10.1000/XYZ"
    assert one(spark, ids.display_doi("x"), x="doi: 10.1000/example;") == "10.1000/example"


@pytest.mark.parametrize("raw, form", [("A &amp; B", "a b"), ("\\emph{Deep} {L}earning", "deep learning"), ("ﬁne Straße", "fine strasse"), ("β-blockers", "beta blockers"), ("é-a", "é a"), (None, ""), ("  ", "")])
def test_normalize(spark, raw, form):
    assert one(spark, text.normalize("x"), x=raw) == form


@pytest.mark.parametrize("raw, y", [("12019", 2019), ("c. 1999a", 1999), ("n.d.", None), (None, None)])
def test_year(spark, raw, y):
    assert one(spark, text.year("x"), x=raw) == y


@pytest.mark.parametrize("raw, form", [("{{A title}}", "{A title}"), ("A &amp; B", "{A & B}"), ("", ""), (None, "")])
def test_field_value(spark, raw, form):
    assert one(spark, text.field_value("x"), x=raw) == form


def test_volumes_compare_by_digits_only(spark):
    assert one(spark, text.field_form("volume", F.col("x")), x="A") == one(spark, text.field_form("volume", F.col("x")), x="B") == ""


def test_small_text_helpers(spark):
    assert one(spark, text.safe_message(F.col("x"), F.lit("Err")), x=" a\r\nb ") == "a b"
    assert one(spark, text.safe_message(F.col("x"), F.lit("Err")), x=None) == "Err"
    assert one(spark, text.file_prefix(F.col("x")), x="a b/c") == "a_b_c"
    assert one(spark, text.file_prefix(F.col("x")), x="con") == "_con"
    assert one(spark, text.split_bilingual(F.col("x")), x="eins / one / 1")["second"] == "one / 1"


def test_citation_key(spark):
    rows = [("Lovelace", "2026", "Reliable work", "10.1/x"), (None, None, None, "10.1000/a/b c"), (None, None, None, None), ("O'Neil van", None, "…x", ""), (None, "2020", None, "10.1000/z"), ("_:", None, None, None)]
    df = spark.createDataFrame(rows, "a string, y string, t string, d string")
    got = [r[0] for r in df.select(ids.citation_key(F.col("a"), F.col("y"), F.col("t"), F.col("d"))).collect()]
    assert got == ["Lovelace2026Reliable", "b", "crossref_entry", "O_Neil_vanx", "2020", "crossref_entry"]


def test_extraction_from_text_fields(spark):
    rows = [("https://pubmed.ncbi.nlm.nih.gov/12345", "", "pubmed/77"), ("", "PMID12345", ""), ("", "", "see pubmed/123"), ("", "", "PMCID pmc12 and 10.48550/arXiv.2101.00001v2.")]
    df = spark.createDataFrame(rows, "url string, note string, howpublished string")
    got = [r["i"] for r in df.select(ids.extract({c: F.col(c) for c in df.columns}).alias("i")).collect()]
    assert [g["pmid"] for g in got] == ["12345", "12345", "", ""]
    assert got[3]["pmcid"] == "PMC12" and got[3]["doi"] == "10.48550/arxiv.2101.00001v2" and got[3]["arxiv"] == "2101.00001"
    only = spark.createDataFrame([("10.48550/arXiv.2101.00001v2",)], "doi string").select(ids.extract({"doi": F.col("doi")}).alias("i")).select(ids.as_map(F.col("i")).alias("m")).first()["m"]
    assert only == {"doi": "10.48550/arxiv.2101.00001v2", "arxiv": "2101.00001"}


def test_cache_key_is_that_of_the_canonical_json(spark):
    import hashlib
    import json

    url, params, headers = 'https://x/"é"', {"b": "tab\t\\ 𝔘 é \x01\x7f", "a": "1"}, {"Accept": "j", "Authorization": "s", "X-API-Key": "s", "COOKIE": "c"}
    want = json.dumps({"url": url, "params": params, "headers": {"accept": "j"}}, ensure_ascii=True, sort_keys=True, separators=(",", ":"))
    df = spark.createDataFrame([(url, params, headers)], "u string, p map<string,string>, h map<string,string>")
    assert df.select(ids.cache_key(F.col("u"), F.col("p"), F.col("h"))).first()[0] == hashlib.sha256(want.encode()).hexdigest()
    none = json.dumps({"url": url, "params": {}, "headers": {}}, sort_keys=True, separators=(",", ":"))
    assert df.select(ids.cache_key(F.col("u"), F.create_map().cast("map<string,string>"))).first()[0] == hashlib.sha256(none.encode()).hexdigest()
    kept = spark.createDataFrame([({"Content-Type": "a", "ETag": "b", "Set-Cookie": "c"},)], "h map<string,string>").select(ids.kept_headers(F.col("h"))).first()[0]
    assert kept == {"Content-Type": "a", "ETag": "b"}


@pytest.mark.parametrize(
    "raw, form",
    [
        ("  title = {{A}},\n  year = {1}", "  title = {A},\n  year = {1}"), ("@a{k, title = {{A {b}}}, x = {{c}}", "@a{k, title = {A {b}}, x = {{c}}"), ("x {{y}}", "x {{y}}"), ("t = {{a", "t = {{a"), (None, None),
    ],
)
def test_collapse_braces(spark, raw, form):
    assert one(spark, text.collapse_braces(F.col("x")), x=raw) == form


@pytest.mark.parametrize("raw, form", [("a: b  c", "a__b_c"), ("-x-", "x"), ("_. -", "result"), ("com1", "_com1"), ("x" * 120, "x" * 100)])
def test_file_prefix(spark, raw, form):
    assert one(spark, text.file_prefix(F.col("x")), x=raw) == form
