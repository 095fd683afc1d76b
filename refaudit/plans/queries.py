"""Queries of the engine's operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refaudit.functions import identifiers as ids
from refaudit.functions import text
from refaudit.operators import lookup, merge, ranking, report, scoring, similarity
from refaudit.plans import sql
from refaudit.plans.engine import FIELDS, Engine, Settings
from refaudit.session import materialize, read
from refaudit.sources import adapters, bibtex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql_text: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql_text:
            SQL[f.__name__] = sql_text
        return f

    return add


# ---- identifiers ------------------------------------------------------------------------------


@query(f"SELECT rec_id, {sql.doi('doi')} AS doi_form, {sql.display_doi('doi')} AS doi_shown FROM search_openalex")
def i_doi(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "search_openalex").select("rec_id", ids.doi("doi").alias("doi_form"), ids.display_doi("doi").alias("doi_shown"))


@query(
    f"SELECT rec_id, {sql.pmid('pmid')} AS pmid_form, {sql.pmcid('pmcid')} AS pmcid_form, {sql.doi('doi')} AS doi_form, "
    f"({sql.pmid('pmid')} <> '' OR {sql.pmcid('pmcid')} <> '' OR {sql.doi('doi')} <> '') AS has_any FROM search_europepmc"
)
def i_pubmed_ids(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "search_europepmc").select("rec_id", ids.pmid("pmid").alias("pmid_form"), ids.pmcid("pmcid").alias("pmcid_form"), ids.doi("doi").alias("doi_form"))
    return e.withColumn("has_any", (F.col("pmid_form") != "") | (F.col("pmcid_form") != "") | (F.col("doi_form") != ""))


_FREE_TEXT = (
    "SELECT rec_id, doi AS given, CASE WHEN rec_id % 7 = 0 THEN doi END AS doi, CASE WHEN rec_id % 5 = 0 THEN 'PMID : ' || pmid END AS pmid, CASE WHEN rec_id % 5 = 1 THEN pmcid END AS pmcid, CASE WHEN rec_id % 11 = 0 THEN 'arXiv: 2101.00001v2' WHEN rec_id % 11 = 1 THEN 'http://arxiv.org/pdf/hep-th/9901001.pdf' END AS eprint, "
    "CASE rec_id % 4 WHEN 0 THEN doi WHEN 1 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid WHEN 2 THEN 'https://www.example.org/pubmed/' || pmid END AS url, CASE rec_id % 3 WHEN 0 THEN 'PMID' || pmid || '; ' || coalesce(pmcid, '') WHEN 1 THEN 'see {' || doi || '}.' END AS note, "
    "CASE WHEN rec_id % 13 = 0 THEN 'https://doi.org/10.48550/arXiv.2101.0000' || (rec_id % 10) || 'v3' END AS howpublished FROM search_europepmc"
)


@query(sql.extract(_FREE_TEXT, "rec_id"))
def i_extract(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of fields and free text, the fields of the table spread over both."""
    r, n = read(spark, d, "search_europepmc"), F.col("rec_id")
    rows = {
        "doi": F.when(n % 7 == 0, F.col("doi")), "pmid": F.when(n % 5 == 0, F.concat(F.lit("PMID : "), "pmid")), "pmcid": F.when(n % 5 == 1, F.col("pmcid")),
        "eprint": F.when(n % 11 == 0, "arXiv: 2101.00001v2").when(n % 11 == 1, "http://arxiv.org/pdf/hep-th/9901001.pdf"),
        "url": F.when(n % 4 == 0, F.col("doi")).when(n % 4 == 1, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid")).when(n % 4 == 2, F.concat(F.lit("https://www.example.org/pubmed/"), "pmid")),
        "note": F.when(n % 3 == 0, F.concat(F.lit("PMID"), "pmid", F.lit("; "), F.coalesce("pmcid", F.lit("")))).when(n % 3 == 1, F.concat(F.lit("see {"), "doi", F.lit("}."))),
        "howpublished": F.when(n % 13 == 0, F.concat(F.lit("https://doi.org/10.48550/arXiv.2101.0000"), (n % 10).cast("string"), F.lit("v3"))),
    }
    named = ids.with_ids(r.select("rec_id", *[v.alias(k) for k, v in rows.items()]), {k: F.col(k) for k in rows}, "_")
    return named.select("rec_id", *[F.col(f"_{k}").alias(f"{k}_form") for k in ("doi", "pmid", "pmcid", "arxiv")])


@query(
    "SELECT rec_id, host, (host = 'arxiv.org' OR ends_with(host, '.arxiv.org')) AS on_arxiv FROM (SELECT rec_id, "
    "coalesce(rtrim(lower(regexp_extract(trim(coalesce(work_url, '')), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#:]*)', 1)), '.'), '') AS host FROM search_openalex)"
)
def i_url_host(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "search_openalex").select("rec_id", ids.url_host("work_url").alias("host"), ids.is_arxiv_url("work_url").alias("on_arxiv"))


@query(f"SELECT rec_id, {sql.citation_key('fam', 'yr', 'ttl', 'doi')} AS cite_key FROM (SELECT rec_id, CASE WHEN rec_id % 5 <> 0 THEN author[1].family END AS fam, CASE WHEN rec_id % 5 <> 0 THEN CAST(published.\"date-parts\"[1][1] AS VARCHAR) END AS yr, CASE WHEN rec_id % 10 <> 0 THEN title[1] END AS ttl, doi FROM search_crossref)")
def i_citation_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys of all records; author and year, and title, are left out of some, so that all ways occur."""
    n = F.col("rec_id")
    year = F.get(F.get(F.col("published")["date-parts"], F.lit(0)), F.lit(0)).cast("string")
    key = ids.citation_key(F.when(n % 5 != 0, F.get("author", F.lit(0))["family"]), F.when(n % 5 != 0, year), F.when(n % 10 != 0, F.get("title", F.lit(0))), F.col("doi"))
    return read(spark, d, "search_crossref").select("rec_id", key.alias("cite_key"))


@query(
    "SELECT rec_id, sha256('{\"headers\":{\"accept\":' || " + sql.json_text("coalesce(work_type, '')") + " || '},\"params\":{\"id\":\"' || CAST(rec_id AS VARCHAR) || '\",\"query\":' || " + sql.json_text("coalesce(title, '')")
    + " || '},\"url\":' || " + sql.json_text("coalesce(work_url, '')") + " || '}') AS cache_key FROM search_openalex"
)
def i_cache_key(spark: SparkSession, d: str) -> DataFrame:
    params = F.create_map(F.lit("query"), F.coalesce("title", F.lit("")), F.lit("id"), F.col("rec_id").cast("string"))
    headers = F.create_map(F.lit("Authorization"), F.lit("secret"), F.lit("Accept"), F.coalesce("work_type", F.lit("")), F.lit("X-API-Key"), F.lit("k"))
    return read(spark, d, "search_openalex").select("rec_id", ids.cache_key(F.coalesce("work_url", F.lit("")), params, headers).alias("cache_key"))


# ---- text -------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {sql.normalize('text')} AS normal FROM documents")
def f_normalize_native(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.normalize_native("text").alias("normal"))


@query(
    "WITH " + sql.normalized("SELECT 'o' || case_id AS id, original.title AS x FROM cases UNION ALL SELECT 'c' || case_id, candidate.title FROM cases")
    + " SELECT case_id, o.t AS original_title, c.t AS candidate_title FROM cases JOIN normal o ON o.id = 'o' || case_id JOIN normal c ON c.id = 'c' || case_id"
)
def f_normalize(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cases").select("case_id", text.normalize("original.title").alias("original_title"), text.normalize("candidate.title").alias("candidate_title"))


@query(f"SELECT rec_id, {sql.clean('title')} AS cleaned, lower({sql.clean('title')}) AS lowered, {sql.comparable('title')} AS comparable FROM search_europepmc")
def f_titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "search_europepmc").select("rec_id", text.clean_title("title").alias("cleaned"), text.lower_title("title").alias("lowered"), text.comparable_title("title").alias("comparable"))


@query(f"SELECT case_id, {sql.year('original.\"year\"')} AS original_year, {sql.year('candidate.\"year\"')} AS candidate_year FROM cases")
def f_year(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "cases").select("case_id", text.year("original.year").alias("original_year"), text.year("candidate.year").alias("candidate_year"))


@query(
    f"SELECT rec_id, regexp_replace(coalesce(journalvolume, ''), '[^\\p{{Nd}}]', '', 'g') AS volume_form, regexp_replace(coalesce(pubyear, ''), '[^\\p{{Nd}}]', '', 'g') AS year_form, {sql.doi('doi')} AS doi_form, "
    f"{sql.normalize("trim(coalesce(pageinfo, ''))")} AS pages_form, {sql.normalize("trim(coalesce(journaltitle, ''))")} AS journal_form FROM search_europepmc"
)
def f_field_forms(spark: SparkSession, d: str) -> DataFrame:
    n = text.normalize_native
    form = lambda f, c: text.field_form(f, F.col(c), n)
    return read(spark, d, "search_europepmc").select("rec_id", form("volume", "journalvolume").alias("volume_form"), form("year", "pubyear").alias("year_form"), form("doi", "doi").alias("doi_form"), form("pages", "pageinfo").alias("pages_form"), form("journal", "journaltitle").alias("journal_form"))


@query(f"SELECT case_id, {sql.field_value('original.title')} AS title_value, nullif(trim(original.author), '') AS author_value FROM cases WHERE original IS NOT NULL")
def f_clean(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "cases").where("original is not null")
    return c.select("case_id", text.field_value("original.title", native=True).alias("title_value"), text.present(F.col("original.author")).alias("author_value"))


@query(
    "SELECT rec_id, CASE WHEN m = '' THEN 'Error' ELSE substr(m, 1, 300) END AS message, string_split(b, ' / ')[1] AS first_part, CASE WHEN contains(b, ' / ') THEN substr(b, strpos(b, ' / ') + 3) ELSE b END AS second_part, "
    "CASE WHEN p = '' THEN 'result' ELSE p END AS prefix FROM (SELECT rec_id, trim(regexp_replace(coalesce(title || chr(10) || journaltitle, ''), '[\\r\\n]+', ' ', 'g')) AS m, coalesce(title, '') || ' / ' || coalesce(journaltitle, '') || ' / x' AS b, "
    "substr(trim(regexp_replace(regexp_replace(coalesce(title, ''), '[<>:\"/\\\\|?*\\x00-\\x1f]+', '_', 'g'), '[\\t\\n\\x{0B}\\f\\r ]+', '_', 'g'), ' ._-'), 1, 100) AS p FROM search_europepmc)"
)
def f_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages on one line, texts in two languages split once, and file name prefixes."""
    e = read(spark, d, "search_europepmc")
    halves = text.split_bilingual(F.concat(F.coalesce("title", F.lit("")), F.lit(" / "), F.coalesce("journaltitle", F.lit("")), F.lit(" / x")))
    message = text.safe_message(F.concat("title", F.lit("\n"), "journaltitle"), F.lit("Error"))
    return e.select("rec_id", message.alias("message"), halves["first"].alias("first_part"), halves["second"].alias("second_part"), text.file_prefix(F.col("title")).alias("prefix"))


@query(
    "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN contains(l, '{{') AND contains(substr(l, strpos(l, '{{') + 2), '}}') AND regexp_matches(substr(l, 1, strpos(l, '{{') - 1), '\\w\\s*=\\s*$') "
    "THEN substr(l, 1, strpos(l, '{{') - 1) || '{' || replace(substr(l, strpos(l, '{{') + 2), string_split(substr(l, strpos(l, '{{') + 2), '}}')[1] || '}}', string_split(substr(l, strpos(l, '{{') + 2), '}}')[1] || '}') ELSE l END), chr(10)) AS collapsed FROM documents WHERE kind = 'bibtex'"
)
def f_collapse_braces(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("kind = 'bibtex'").select("doc_id", text.collapse_braces(F.col("text")).alias("collapsed"))


# ---- similarity and scoring -------------------------------------------------------------------

_PAIRS = "SELECT case_id, expected, original AS o, candidate AS c FROM cases WHERE original IS NOT NULL AND candidate IS NOT NULL"


@query(sql.signals(_PAIRS, "case_id, expected, round(title_sim, 4) AS title_sim, round(author_sim, 4) AS author_sim, year_sim"))
def m_signals(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "cases").where("original is not null and candidate is not null")
    n = text.normalize_native
    a = similarity.jaccard(similarity.families(F.col("original.author"), n), similarity.families(F.col("candidate.author"), n))
    return p.select("case_id", "expected", F.round(similarity.title(n("original.title"), n("candidate.title"), ratio=False), 4).alias("title_sim"), F.round(a, 4).alias("author_sim"), similarity.year(F.col("original.year"), F.col("candidate.year")).alias("year_sim"))


def _assessed(spark: SparkSession, d: str, exact: bool) -> DataFrame:
    return scoring.assess(read(spark, d, "cases").where("original is not null and candidate is not null"), exact=exact)


@query(sql.scored(_PAIRS, "case_id, round(score, 4) AS score, status"))
def m_score_native(spark: SparkSession, d: str) -> DataFrame:
    return _assessed(spark, d, False).select("case_id", F.round("score", 4).alias("score"), "status")


@query(sql.assessed("SELECT case_id, expected, round(score, 4) AS score, status, round(title_sim, 4) AS title_sim, round(author_sim, 4) AS author_sim, year_sim, shared AS identifier_exact, CASE WHEN shared THEN 'doi' END AS shared_identifiers, CASE WHEN clash THEN 'doi' END AS identifier_conflicts FROM e"))
def m_assess(spark: SparkSession, d: str) -> DataFrame:
    a = _assessed(spark, d, True)
    signals = [F.col("signals.title").alias("title_sim"), F.col("signals.authors").alias("author_sim"), F.col("signals.year").alias("year_sim")]
    return a.select("case_id", "expected", F.round("score", 4).alias("score"), "status", *signals, "signals.identifier_exact", "signals.shared_identifiers", "signals.identifier_conflicts")


_FULL_PAIRS = "SELECT o.rec_id AS left_id, r.rec_id AS right_id, o.biblio.first_page AS fp, o.biblio.last_page AS lp, o.primary_location.source.display_name AS v, r.page AS pg, r.container_title[1] AS ct FROM search_openalex o JOIN search_crossref r ON " + sql.doi("o.doi") + " = " + sql.doi("r.doi") + " WHERE " + sql.doi("o.doi") + " <> ''"


@query(
    f"WITH p AS ({_FULL_PAIRS}), n AS (SELECT *, {sql.normalize('v')} AS nv, {sql.normalize('ct')} AS nc, {sql.normalize("coalesce(fp, '') || '-' || coalesce(lp, '')")} AS np, {sql.normalize('pg')} AS ng FROM p), "
    f"w AS (SELECT *, {sql._tokens('nv')} AS wo, {sql._tokens('nc')} AS wc, CASE WHEN length(nv) <= length(nc) THEN nv ELSE nc END AS sh, CASE WHEN length(nv) <= length(nc) THEN nc ELSE nv END AS lo FROM n) "
    f"SELECT left_id, right_id, CASE WHEN coalesce(v, '') <> '' AND coalesce(ct, '') <> '' THEN round(CASE WHEN nv = '' OR nc = '' THEN 0.0 WHEN nv = nc THEN 1.0 ELSE greatest(coalesce({sql._jaccard('wo', 'wc')}, 0.0), CASE WHEN contains(lo, sh) AND len(string_split(sh, ' ')) >= 4 AND length(sh) / CAST(length(lo) AS DOUBLE) >= 0.65 THEN length(sh) / CAST(length(lo) AS DOUBLE) ELSE 0.0 END) END, 4) END::DOUBLE AS venue_sim, "
    "CASE WHEN coalesce(pg, '') <> '' THEN CAST(np = ng AS INTEGER) END::DOUBLE AS pages_sim FROM w"
)
def m_venue_pages(spark: SparkSession, d: str) -> DataFrame:
    """Venue and pages of the records of two sources that share a DOI."""
    o, r = read(spark, d, "search_openalex"), read(spark, d, "search_crossref")
    a = o.select(F.col("rec_id").alias("left_id"), ids.doi("doi").alias("k"), F.struct(F.col("primary_location.source.display_name").alias("journal"), F.concat(F.coalesce("biblio.first_page", F.lit("")), F.lit("-"), F.coalesce("biblio.last_page", F.lit(""))).alias("pages")).alias("original"))
    b = r.select(F.col("rec_id").alias("right_id"), ids.doi("doi").alias("k"), F.struct(F.get("container_title", F.lit(0)).alias("journal"), F.col("page").alias("pages")).alias("candidate"))
    got = scoring.assess(a.where("k <> ''").join(b, "k"), exact=False)
    return got.select("left_id", "right_id", F.col("signals.venue").alias("venue_sim"), F.col("signals.pages").alias("pages_sim"))


_LOOSE = "SELECT case_id, " + sql.comparable("original.title") + " AS a, " + sql.comparable("candidate.title") + " AS b FROM cases WHERE original IS NOT NULL AND candidate IS NOT NULL"


@query(
    f"WITH RECURSIVE q AS ({_LOOSE}), " + sql.ratios("SELECT case_id AS id, a, b FROM q WHERE a <> b AND a <> '' AND b <> ''")
    + f", w AS (SELECT q.*, coalesce(r, 0) AS rat, {sql._tokens('a')} AS wa, {sql._tokens('b')} AS wb, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS sh, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS lo FROM q LEFT JOIN ratio ON id = case_id) "
    f"SELECT case_id, CASE WHEN a = '' OR b = '' THEN false WHEN a = b THEN true ELSE greatest(rat, coalesce({sql._jaccard('wa', 'wb')}, 0), CASE WHEN contains(lo, sh) THEN length(sh) / CAST(length(lo) AS DOUBLE) * 0.95 ELSE 0 END) >= 0.85 END AS agree FROM w"
)
def m_loose_title(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "cases").where("original is not null and candidate is not null")
    return p.select("case_id", similarity.loose_title(text.comparable_title("original.title"), text.comparable_title("candidate.title")).alias("agree"))


@query(sql.scored(_PAIRS, "expected, status AS predicted", "SELECT expected, predicted, count(*) AS n FROM ({}) GROUP BY ALL"))
def g_confusion(spark: SparkSession, d: str) -> DataFrame:
    return report.confusion(_assessed(spark, d, False).select("expected", F.col("status").alias("predicted")))


@query(
    sql.scored(
        _PAIRS, "expected, status AS predicted",
        "SELECT count(*) AS cases, round(coalesce(count_if(predicted = expected) / nullif(count(*), 0), 0), 4) AS accuracy, round(coalesce(count_if(predicted = 'matched' AND expected = 'matched') / nullif(count_if(predicted = 'matched'), 0), 0), 4) AS match_precision, "
        "round(coalesce(count_if(predicted = 'matched' AND expected = 'matched') / nullif(count_if(expected = 'matched'), 0), 0), 4) AS match_recall, round(coalesce(count_if(predicted = 'matched' AND expected <> 'matched') / nullif(count(*), 0), 0), 4) AS wrong_auto_match_rate FROM ({})",
    )
)
def g_metrics_native(spark: SparkSession, d: str) -> DataFrame:
    return report.metrics(_assessed(spark, d, False).select("expected", F.col("status").alias("predicted")))


@query(
    sql.assessed(
        ", x AS (SELECT expected, status AS predicted FROM e) SELECT count(*) AS cases, round(coalesce(count_if(predicted = expected) / nullif(count(*), 0), 0), 4) AS accuracy, round(coalesce(count_if(predicted = 'matched' AND expected = 'matched') / nullif(count_if(predicted = 'matched'), 0), 0), 4) AS match_precision, "
        "round(coalesce(count_if(predicted = 'matched' AND expected = 'matched') / nullif(count_if(expected = 'matched'), 0), 0), 4) AS match_recall, round(coalesce(count_if(predicted = 'matched' AND expected <> 'matched') / nullif(count(*), 0), 0), 4) AS wrong_auto_match_rate FROM x"
    )
)
def g_metrics(spark: SparkSession, d: str) -> DataFrame:
    return report.metrics(_assessed(spark, d, True).select("expected", F.col("status").alias("predicted")))


# ---- adapters ---------------------------------------------------------------------------------


@query(sql.A_CROSSREF)
def a_crossref(spark: SparkSession, d: str) -> DataFrame:
    return adapters.adapt(read(spark, d, "search_crossref"), "crossref", ["rec_id"], native=True)


@query(sql.A_OPENALEX)
def a_openalex(spark: SparkSession, d: str) -> DataFrame:
    return adapters.adapt(read(spark, d, "search_openalex"), "openalex", ["rec_id"], native=True)


@query(sql.A_S2)
def a_semantic_scholar(spark: SparkSession, d: str) -> DataFrame:
    return adapters.adapt(read(spark, d, "match_s2"), "semantic_scholar", ["rec_id"], native=True)


@query(sql.A_EPMC)
def a_europe_pmc(spark: SparkSession, d: str) -> DataFrame:
    return adapters.adapt(read(spark, d, "search_europepmc"), "europe_pmc", ["rec_id"], native=True)


@query(sql.A_PUBMED)
def a_pubmed(spark: SparkSession, d: str) -> DataFrame:
    """Summary payloads made of the table's fields, serialized and read back by the adapter."""
    e = read(spark, d, "search_europepmc")
    art = F.filter(F.array(*[F.struct(F.lit(k).alias("idtype"), F.col(c).alias("value")) for k, c in (("doi", "doi"), ("pubmed", "pmid"), ("pmc", "pmcid"))]), lambda a: a["value"].isNotNull())
    authors = F.transform(F.split("authorstring", ", "), lambda n: F.struct(n.alias("name")))
    payload = F.to_json(F.struct(F.col("title"), authors.alias("authors"), F.concat(F.col("pubyear"), F.lit(" Jan 3")).alias("pubdate"), F.col("journaltitle").alias("fulljournalname"), F.col("journalvolume").alias("volume"), "issue", F.col("pageinfo").alias("pages"), art.alias("articleids")))
    return adapters.adapt_json(e.select("rec_id", payload.alias("payload")), "pubmed", ["rec_id"], native=True)


@query(sql.A_DBLP)
def a_dblp(spark: SparkSession, d: str) -> DataFrame:
    """Hit payloads made of the table's fields; a single author is an object, several a list."""
    o = read(spark, d, "search_openalex")
    texts = F.transform("authorships", lambda a: F.struct(a["author"]["display_name"].alias("text")))
    kind = F.when(F.col("work_type") == "book-chapter", "Parts in Books or Collections").when(F.col("work_type") == "proceedings-article", "Conference and Workshop Papers").otherwise("Journal Articles")
    author = F.when(F.size(texts) == 1, F.to_json(texts[0])).when(F.size(texts) > 1, F.to_json(texts))
    pages = F.concat("biblio.first_page", F.lit("-"), "biblio.last_page")
    head = F.to_json(F.struct(kind.alias("type"), "title", F.col("publication_year").cast("string").alias("year"), F.col("primary_location.source.display_name").alias("venue"), F.col("biblio.volume").alias("volume"), pages.alias("pages"), "doi", F.col("work_url").alias("ee")))
    payload = F.when(author.isNotNull(), F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"authors":{"author":'), author, F.lit("}}"))).otherwise(F.col("h"))
    return adapters.adapt_json(o.withColumn("h", head).select("rec_id", payload.alias("payload")), "dblp", ["rec_id"], native=True)


@query(sql.A_CORE)
def a_core(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "match_s2")
    url = F.concat(F.lit("https://core.example/"), F.col("rec_id").cast("string"))
    payload = F.to_json(F.struct("title", "authors", F.col("pub_year").alias("yearPublished"), F.lit("1999-01-01").alias("publishedDate"), F.array("venue").alias("journals"), "doi", url.alias("downloadUrl")))
    return adapters.adapt_json(s.select("rec_id", payload.alias("payload")), "core", ["rec_id"], native=True)


@query(sql.A_BIORXIV)
def a_biorxiv(spark: SparkSession, d: str) -> DataFrame:
    """Payloads made of the table's fields; authors as one text, a list of names or of objects."""
    o, n = read(spark, d, "search_openalex"), F.col("rec_id")
    names = F.transform("authorships", lambda a: a["author"]["display_name"])
    joined = F.array_join(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != ""), "; ")
    authors = F.when(n % 3 == 0, joined).when(n % 3 == 1, F.to_json(names)).otherwise(F.to_json(F.transform(names, lambda x: F.struct(x.alias("name")))))
    venue = F.col("primary_location.source.display_name")
    payload = F.to_json(F.struct("doi", "title", F.concat(F.col("publication_year").cast("string"), F.lit("-02-03")).alias("date"), F.lit("2").alias("version"), F.col("work_type").alias("category"), venue.alias("journal"), F.concat(F.lit("https://x.example/"), n.cast("string")).alias("biorxiv_url"), F.when(n % 2 == 0, F.col("work_url")).alias("preprint_url"), authors.alias("authors")))
    # a list stands in the payload as a list, not as a text
    listed = F.when((n % 3 != 0) & authors.isNotNull(), F.concat(F.regexp_replace(F.to_json(F.struct(F.from_json(payload, adapters.DDL["biorxiv"]).dropFields("authors").alias("x"))), r'^\{"x":|\}\}$', ""), F.lit(',"authors":'), authors, F.lit("}"))).otherwise(payload)
    return adapters.adapt_json(o.select("rec_id", listed.alias("payload")), "biorxiv", ["rec_id"], native=True)


@query(sql.A_ARXIV)
def a_arxiv(spark: SparkSession, d: str) -> DataFrame:
    """Atom entries made of the table's fields, read back as XML."""
    o = read(spark, d, "search_openalex")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), esc(c), F.lit(f"</{name.split(' ')[0]}>")), F.lit(""))
    people = F.array_join(F.transform("authorships", lambda a: F.concat(F.lit("<author>"), tag("name", a["author"]["display_name"]), F.lit("</author>"))), "")
    xml = F.concat(
        F.lit("<entry>"), tag("id", F.concat(F.lit("http://arxiv.org/abs/"), F.col("rec_id").cast("string"), F.lit(".0001v2"))), tag("published", F.concat(F.col("publication_year").cast("string"), F.lit("-01-02T00:00:00Z"))), tag("title", F.col("title")),
        F.coalesce(people, F.lit("")), F.lit('<arxiv:primary_category term="cs.DL"/>'), tag("arxiv:journal_ref", F.col("primary_location.source.display_name")), tag("arxiv:doi", F.col("doi")), F.lit("</entry>"),
    )
    return adapters.adapt_atom(o.select("rec_id", xml.alias("payload")), ["rec_id"], native=True)


# ---- lookup -----------------------------------------------------------------------------------


@query(f"SELECT DISTINCT c.case_id, r.rec_id, 'doi' AS kind FROM cases c JOIN search_crossref r ON {sql.doi('c.original.doi')} = {sql.doi('r.doi')} WHERE {sql.doi('c.original.doi')} <> ''")
def j_exact(spark: SparkSession, d: str) -> DataFrame:
    index = lookup.id_index(read(spark, d, "search_crossref"), "rec_id", {"doi": ids.doi("doi")})
    e = read(spark, d, "cases").select("case_id", ids.doi("original.doi").alias("doi"))
    return lookup.exact(e, index, "case_id", lookup.first_id(["doi"], {"doi": F.col("doi")})).select("case_id", "rec_id", "kind")


@query(
    "WITH e AS (SELECT rec_id AS entry_id, CASE WHEN p <> '' THEN 'pmid' WHEN c <> '' THEN 'pmcid' WHEN d <> '' THEN 'doi' END AS kind, CASE WHEN p <> '' THEN p WHEN c <> '' THEN c ELSE d END AS value FROM "
    f"(SELECT rec_id, {sql.pmid('externalids.\"PubMed\"')} AS p, '' AS c, {sql.doi('coalesce(doi, externalids.\"DOI\")')} AS d FROM match_s2)), "
    f"i AS (SELECT DISTINCT * FROM (SELECT rec_id, 'pmid' AS kind, {sql.pmid('pmid')} AS value FROM search_europepmc UNION ALL SELECT rec_id, 'pmcid', {sql.pmcid('pmcid')} FROM search_europepmc UNION ALL SELECT rec_id, 'doi', {sql.doi('doi')} FROM search_europepmc) WHERE value <> '') "
    "SELECT e.entry_id, i.kind AS kind, i.rec_id FROM e JOIN i ON e.kind = i.kind AND e.value = i.value"
)
def j_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Each entry asked by its first identifier in the source's order, never by a later one."""
    e = read(spark, d, "match_s2").select(F.col("rec_id").alias("entry_id"), ids.pmid("externalids.PubMed").alias("pmid"), F.lit("").alias("pmcid"), ids.doi(F.coalesce("doi", F.col("externalids.DOI"))).alias("doi"))
    r = read(spark, d, "search_europepmc")
    index = lookup.id_index(r, "rec_id", {"pmid": ids.pmid("pmid"), "pmcid": ids.pmcid("pmcid"), "doi": ids.doi("doi")})
    kinds = adapters.ACCESS["europe_pmc"][0]
    return lookup.exact(e, index, "entry_id", lookup.first_id(kinds, {k: F.col(k) for k in kinds}))


@query(
    f"WITH asked AS (SELECT rec_id AS e, {sql.normalize('title')} AS t FROM match_s2), held AS (SELECT rec_id AS r, {sql.normalize('title')} AS t FROM search_europepmc), {sql.top_titles()} "
    "SELECT e AS entry_id, r AS rec_id, CAST(shared AS INTEGER) AS shared, CAST(rank AS INTEGER) AS rank FROM top"
)
def j_title_top(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "match_s2").select(F.col("rec_id").alias("entry_id"), text.normalize_native("title").alias("t"))
    r = read(spark, d, "search_europepmc").select("rec_id", text.normalize_native("title").alias("rt"))
    return lookup.by_title(e, r, "entry_id", "rec_id", F.col("t"), F.col("rt"))


@query(
    f"WITH ids AS (SELECT DISTINCT s.rec_id AS entry_id, {sql.pmid('p.pmid')} AS pmid FROM match_s2 s JOIN search_europepmc p ON {sql.doi('s.doi')} = {sql.doi('p.doi')} WHERE {sql.doi('s.doi')} <> '' AND {sql.pmid('p.pmid')} <> '') "
    f"SELECT * FROM (SELECT ids.entry_id, ids.pmid, q.rec_id FROM ids JOIN search_europepmc q ON {sql.pmid('q.pmid')} = ids.pmid) QUALIFY row_number() OVER (PARTITION BY entry_id, pmid ORDER BY rec_id) <= 5"
)
def j_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """A search that yields ids, then the records of those ids."""
    p = read(spark, d, "search_europepmc").select("rec_id", ids.doi("doi").alias("doi"), ids.pmid("pmid").alias("pmid"))
    s = read(spark, d, "match_s2").select(F.col("rec_id").alias("entry_id"), ids.doi("doi").alias("doi")).where("doi <> ''")
    hits = s.join(p.select("doi", "rec_id"), "doi")
    return lookup.two_hop(hits, p, "entry_id", "rec_id", F.col("pmid")).withColumnRenamed("via", "pmid")


@query(
    f"WITH e AS (SELECT rec_id AS entry_id, {sql.doi('doi')} AS d, {sql.comparable('title')} AS t FROM match_s2), r AS (SELECT rec_id, {sql.doi('doi')} AS d, {sql.comparable("coalesce(title[1], '')")} AS t FROM search_crossref), "
    "x AS (SELECT DISTINCT e.entry_id, r.rec_id, 'doi' AS via FROM e JOIN r ON e.d = r.d WHERE e.d <> '') "
    "SELECT * FROM x UNION ALL SELECT DISTINCT e.entry_id, r.rec_id, 'title' FROM e JOIN r ON e.t = r.t WHERE e.t <> '' AND e.entry_id NOT IN (SELECT entry_id FROM x)"
)
def j_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Exact DOI, else (only where that finds nothing) the same comparable title."""
    e = read(spark, d, "match_s2").select(F.col("rec_id").alias("entry_id"), ids.doi("doi").alias("doi"), text.comparable_title("title").alias("t"))
    r = read(spark, d, "search_crossref").select("rec_id", ids.doi("doi").alias("doi"), text.comparable_title(F.get("title", F.lit(0))).alias("t"))
    hits = e.where("doi <> ''").join(r.select("rec_id", "doi"), "doi").select("entry_id", "rec_id", F.lit("doi").alias("via")).distinct()
    search = lambda rest: rest.where("t <> ''").join(r.select("rec_id", "t"), "t").select("entry_id", "rec_id", F.lit("title").alias("via")).distinct()
    return lookup.with_fallback(hits, e, search, "entry_id")


_REGISTRY = ", ".join(f"('{n}')" for n in adapters.ACCESS)
_SOURCES = ", ".join(f"('{n}', {p}, {str(on).lower()})" for n, p, on in ranking.SOURCES)


@query(f"SELECT s.source, s.base_pos, CASE WHEN r.name IS NULL THEN 'skipped' ELSE 'ready' END AS state FROM (SELECT n AS source, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS base_pos FROM (VALUES {_SOURCES}) t(n, p, e) WHERE e) s LEFT JOIN (VALUES {_REGISTRY}) r(name) ON r.name = s.source")
def j_registry(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(n,) for n in adapters.ACCESS], "source string").withColumn("k", F.lit(True))
    return ranking.sources(spark).join(known, "source", "left").select("source", "base_pos", F.when(F.col("k"), "ready").otherwise("skipped").alias("state"))


# ---- ranking, selection, outcome --------------------------------------------------------------


@query(sql.R_RANK)
def r_rank_sources(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "search_crossref").select("rec_id", "doi", F.get("container_title", F.lit(0)).alias("journal"), "publisher", F.get("title", F.lit(0)).alias("title"))
    return ranking.rank_sources(e, {c: F.col(c) for c in ("doi", "journal", "publisher", "title")}, "rec_id", ranking.sources(spark))


_EVENT_STATUS = {"view": "no_match", "signup": "matched", "click": "ambiguous", "error": "network_error", "purchase": "identifier_conflict"}


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Event streams read as result rows: (entry, source, rank, source_status, score)."""
    e = read(spark, d, "events")
    status = F.create_map(*[F.lit(x) for kv in _EVENT_STATUS.items() for x in kv])[F.col("event_type")]
    entry = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    rows = e.select(entry.alias("entry"), "event_id", status.alias("source_status"), F.round(F.col("value") % 1, 2).alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("entry").orderBy("event_id")))
    return rows.withColumn("source", F.concat(F.lit("s"), F.col("rank").cast("string"))).drop("event_id")


@query(sql.w_select(_EVENT_STATUS))
def w_select(spark: SparkSession, d: str) -> DataFrame:
    """Selection among the candidates of a source, the events of an entry's day as candidates."""
    c = _results(spark, d).where("source_status <> 'network_error'").select("entry", F.col("source_status").alias("status"), F.col("score"), F.col("rank").alias("cand_pos"))
    return ranking.select(c, ["entry"])


@query(sql.w_consulted(_EVENT_STATUS, "SELECT entry, source, CAST(rank AS INTEGER) AS rank, source_status FROM walked"))
def w_early_stop(spark: SparkSession, d: str) -> DataFrame:
    return ranking.consulted(_results(spark, d), "entry").select("entry", "source", "rank", "source_status")


@query(sql.w_consulted(_EVENT_STATUS, sql.OUTCOME))
def g_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = ranking.outcomes(ranking.consulted(_results(spark, d), "entry", stop_on_match=False), "entry")
    return o.withColumn("providers", _listed("providers"))


def _listed(providers: str) -> Column:
    return F.array_join(F.transform(providers, lambda p: F.concat(p["source"], F.lit("="), p["status"])), ",")


@query(sql.G_COUNTS)
def g_bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    c = _assessed(spark, d, False)
    bucket = F.when(F.col("status") == "matched", F.when(F.col("score") < 1, "updated").otherwise("verified")).when(F.col("status") == "no_match", "not_found").otherwise(F.col("status"))
    return report.bucket_counts(c.select(bucket.alias("bucket")))


@query("SELECT citekey, count(*) AS n FROM cases WHERE citekey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def g_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return report.duplicate_keys(read(spark, d, "cases"), "citekey")


@query("SELECT case_id, citekey FROM cases WHERE trim(coalesce(citekey, '')) <> '' AND citekey NOT IN (SELECT citekey FROM cases WHERE citekey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def p_valid_keys(spark: SparkSession, d: str) -> DataFrame:
    return report.valid_keys(read(spark, d, "cases"), "citekey").select("case_id", "citekey")


@query(
    "SELECT doc_id, status, count(*) AS n FROM (SELECT doc_id, CASE WHEN c BETWEEN 200 AND 299 THEN 'ok' WHEN c = 404 THEN 'no_match' WHEN c = 429 THEN 'rate_limited' WHEN c IN (401, 403) THEN 'auth_error' ELSE 'provider_error' END AS status "
    "FROM (SELECT doc_id, CAST(unnest(regexp_extract_all(text, 'status=([0-9]{3})', 1)) AS INTEGER) AS c FROM documents WHERE kind = 'log')) GROUP BY ALL"
)
def p_http_status(spark: SparkSession, d: str) -> DataFrame:
    codes = read(spark, d, "documents").where("kind = 'log'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("status=([0-9]{3})"), F.lit(1))).alias("c"))
    return codes.select("doc_id", ranking.status_of_http(F.col("c").cast("int")).alias("status")).groupBy("doc_id", "status").agg(F.count("*").alias("n"))


_EXIT = {"view": "not_found", "signup": "updated", "click": "ambiguous", "error": "source_unavailable", "purchase": "identifier_conflict"}


@query(
    "WITH r AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS entry, CASE WHEN round(value % 1, 2) < 0.02 THEN 'invalid_input' WHEN round(value % 1, 2) > 0.97 THEN 'errors' ELSE CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EXIT.items()) + " END END AS b, round(value % 1, 2) <> 0.5 AS whole FROM events) "
    "SELECT entry, CASE WHEN count_if(b = 'invalid_input') > 0 THEN 5 WHEN NOT bool_and(whole) OR count_if(b IN ('source_unavailable', 'errors')) > 0 THEN 4 WHEN count_if(b IN ('ambiguous', 'not_found', 'identifier_conflict')) > 0 THEN 3 WHEN count_if(b = 'updated') > 0 THEN 2 ELSE 0 END AS code FROM r GROUP BY 1"
)
def p_exit_code(spark: SparkSession, d: str) -> DataFrame:
    """Exit code of each user's day, taken as a run of its own; all codes but 0 occur."""
    part = F.round(F.col("value") % 1, 2)
    named = F.create_map(*[F.lit(x) for kv in _EXIT.items() for x in kv])[F.col("event_type")]
    bucket = F.when(part < 0.02, "invalid_input").when(part > 0.97, "errors").otherwise(named)
    rows = read(spark, d, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("entry"), bucket.alias("b"), (part != 0.5).alias("whole"))
    g = rows.groupBy("entry").agg(*[F.count_if(F.col("b") == b).alias(b) for b in report.BUCKETS], F.bool_and("whole").alias("whole"))
    return g.select("entry", ranking.exit_code({b: F.col(b) for b in report.BUCKETS}, F.col("whole")).alias("code"))


# ---- merge ------------------------------------------------------------------------------------

_SIDES = ("title", "author", "year", "doi")


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "cases").where("original is not null and candidate is not null")
    conf = F.when(F.col("expected") == "matched", 0.95).otherwise(0.80)
    side = lambda s: {f: F.col(f"{s}.{f}") for f in _SIDES}
    return merge.decisions(c, ["case_id"], side("original"), side("candidate"), conf, norm=text.normalize_native)


@query(sql.decisions("SELECT case_id, field, original, suggested, normalized_equal, action FROM acted"))
def d_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decisions(spark, d)


@query(sql.decisions("SELECT case_id, coalesce(string_agg(field || '=' || suggested, ';' ORDER BY field) FILTER (action IN ('add', 'update')), '') AS changes, coalesce(string_agg(field || ':' || original || '>' || suggested, ';' ORDER BY field) FILTER (action IN ('add', 'update')), '') AS differences, string_agg(field || ' ' || action, ',' ORDER BY field) AS actions, CAST(count_if(action IN ('add', 'update')) AS BIGINT) AS n_applied, CAST(count_if(NOT normalized_equal AND action <> 'keep_original') AS BIGINT) AS n_meaningful FROM acted GROUP BY 1"))
def d_merged(spark: SparkSession, d: str) -> DataFrame:
    m = merge.merged(_decisions(spark, d), ["case_id"])
    listed = lambda c, f: F.array_join(F.transform(F.array_sort(F.map_entries(c)), f), ";")
    changes = listed("changes", lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    differences = listed("differences", lambda e: F.concat(e["key"], F.lit(":"), e["value"]["original"], F.lit(">"), e["value"]["suggested"]))
    actions = F.array_join(F.transform("field_diffs", lambda x: F.concat(x["field"], F.lit(" "), x["action"])), ",")
    return m.select("case_id", changes.alias("changes"), differences.alias("differences"), actions.alias("actions"), "n_applied", "n_meaningful")


@query(
    "WITH p AS (SELECT case_id, original AS o, candidate AS c FROM cases WHERE original IS NOT NULL AND candidate IS NOT NULL), l AS (SELECT case_id, f AS field, trim(coalesce(CASE f WHEN 'title' THEN o.title WHEN 'author' THEN o.author WHEN 'year' THEN o.\"year\" ELSE o.doi END, '')) AS original, "
    "trim(coalesce(CASE f WHEN 'title' THEN c.title WHEN 'author' THEN c.author WHEN 'year' THEN c.\"year\" ELSE c.doi END, '')) AS updated FROM p, (VALUES ('title'), ('author'), ('year'), ('doi')) t(f)) "
    "SELECT * FROM l WHERE lower(regexp_replace(original, '[{}]', '', 'g')) <> lower(regexp_replace(updated, '[{}]', '', 'g'))"
)
def d_differences(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "cases").where("original is not null and candidate is not null")
    long = lambda s: c.select("case_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{s}.{f}").alias("value")) for f in _SIDES])).alias("x")).select("case_id", "x.*").where("value is not null")
    return merge.differences(long("original"), long("candidate"), ["case_id"])


# ---- sources and sinks ------------------------------------------------------------------------


@query(
    r"WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?ms)^@\w+\{.*?^\}')) AS x, generate_subscripts(regexp_extract_all(text, '(?ms)^@\w+\{.*?^\}'), 1) AS n FROM documents WHERE kind = 'bibtex') "
    r"SELECT doc_id, CAST(n - 1 AS INTEGER) AS pos, regexp_extract(x, '^@\w+\{([^,\s]+)', 1) AS key, regexp_extract(x, '^@(\w+)', 1) AS entrytype, CAST(len(list_distinct(regexp_extract_all(x, '([^\s\"#%''(),={}]+)\s*=', 1))) AS INTEGER) AS n_fields, coalesce(nullif(regexp_extract(x, '\btitle = ([^\s{]+)', 1), ''), nullif(regexp_extract(x, '(?m)\btitle = \{(.*)\},?$', 1), '')) AS title FROM e"
)
def s_bibtex_scan(spark: SparkSession, d: str) -> DataFrame:
    return bibtex.scan(read(spark, d, "documents").where("kind = 'bibtex'"), ["doc_id"]).select("doc_id", "pos", "key", "entrytype", F.size("fields").alias("n_fields"), F.col("fields")["title"].alias("title"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^@[a-z]+\\{')) AS n FROM documents WHERE kind = 'bibtex' AND regexp_matches(text, '(?m)^@[a-z]+\\{')")
def s_bibtex_heads(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("kind = 'bibtex'")
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(?m)^@[a-z]+\{"), F.lit(0))).cast("bigint").alias("n")).where("n > 0")


_WRITTEN = ("title", "author", "journal", "booktitle", "volume", "number", "pages", "year", "publisher", "doi")


@query(
    f"WITH a AS ({sql.A_CROSSREF}), l AS (SELECT rec_id, ord, f, CASE f " + " ".join(f"WHEN '{f}' THEN {f}" for f in _WRITTEN) + f" END AS v FROM a, (VALUES {', '.join(f"({i}, '{f}')" for i, f in enumerate(_WRITTEN))}) x(ord, f)), "
    "t AS (SELECT rec_id, string_agg(',' || chr(10) || '  ' || f || ' = {' || v || '}', '' ORDER BY ord) AS body FROM l WHERE v IS NOT NULL GROUP BY 1) "
    "SELECT a.rec_id, replace('@' || \"ENTRYTYPE\" || '{r' || CAST(a.rec_id AS VARCHAR) || coalesce(body, '') || chr(10) || '}' || chr(10), 'arXiv (Cornell University)', 'arXiv') AS bibtex FROM a LEFT JOIN t ON t.rec_id = a.rec_id"
)
def k_serialize(spark: SparkSession, d: str) -> DataFrame:
    e = adapters.adapt(read(spark, d, "search_crossref"), "crossref", ["rec_id"], native=True)
    fields = {f: F.col(f) for f in e.columns if f not in ("rec_id", "ENTRYTYPE")}
    return e.select("rec_id", bibtex.serialize(F.concat(F.lit("r"), F.col("rec_id").cast("string")), F.col("ENTRYTYPE"), fields).alias("bibtex"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    """The labelled pairs as results of a run: some of them from sources that were not complete."""
    c = _assessed(spark, d, False)
    s = F.col("status")
    bucket = F.when(s == "matched", F.when(F.col("score") < 1, "updated").otherwise("verified")).when(s == "no_match", "not_found").otherwise(s)
    diff = F.struct(F.lit("title").alias("field"), F.when(s == "matched", "update").otherwise("keep_original").alias("action"))
    status = F.when(bucket == "updated", "metadata_mismatch").otherwise(bucket)
    c = materialize(c.select("case_id", "status", "score"))
    return c.select(F.col("case_id").alias("pos"), F.concat(F.lit("c"), F.col("case_id").cast("string")).alias("key"), bucket.alias("bucket"), status.alias("status"), (F.col("case_id") % 20 != 0).alias("complete"), F.round("score", 4).alias("confidence"), F.concat(F.lit('status "'), s, F.lit('", from a pair')).alias("reason"), F.lit("crossref").alias("platform"), F.array(diff).alias("field_diffs"))


_BUCKET_LIST = "[" + ", ".join(f"'{b}'" for b in report.BUCKETS) + "]"
_RESULTS = sql.scored(
    _PAIRS, "case_id AS pos, 'c' || CAST(case_id AS VARCHAR) AS key, CASE WHEN status = 'matched' THEN CASE WHEN score < 1 THEN 'updated' ELSE 'verified' END WHEN status = 'no_match' THEN 'not_found' ELSE status END AS bucket, status AS st, case_id % 20 <> 0 AS complete, round(score, 4) AS confidence, 'status \"' || status || '\", from a pair' AS reason, 'crossref' AS platform",
    "WITH r AS (SELECT *, CASE WHEN bucket = 'updated' THEN 'metadata_mismatch' ELSE bucket END AS status FROM ({})), q AS (SELECT bool_and(complete) AND count_if(bucket IN ('errors', 'invalid_input')) = 0 AS complete, count(*) AS total, " + ", ".join(f"CAST(count_if(bucket = '{b}') AS BIGINT) AS {b}" for b in report.BUCKETS) + " FROM r) ",
)
_COUNTS_JSON = " || ',' || ".join(f"'\"{b}\":' || {b}" for b in ("total", *report.BUCKETS))
_ENTRY_JSON = """'"key":"' || key || '","status":"' || status || '","complete":' || complete || ',"confidence":' || CAST(confidence AS VARCHAR) || ',"reason":"' || replace(reason, '"', '\\"') || '","platform":"' || platform || '","field_diffs":[{"field":"title","action":"' || CASE WHEN st = 'matched' THEN 'update' ELSE 'keep_original' END || '"}]}'"""
_PLACE = f"CAST(list_position({_BUCKET_LIST}, bucket) AS INTEGER) AS bucket_ord, pos"
_NOWHERE = "CAST(NULL AS INTEGER) AS bucket_ord, CAST(NULL AS BIGINT) AS pos"


def _shown(lines: DataFrame) -> DataFrame:
    return lines.select("part", F.col("at.bucket").alias("bucket_ord"), F.col("at.pos").alias("pos"), "value")


@query(
    _RESULTS + f"SELECT 0 AS part, {_NOWHERE}, concat_ws(chr(10), repeat('=', 72), 'Report on the reference list', 'Complete: ' || CASE WHEN complete THEN 'yes' ELSE 'no' END, repeat('=', 72), 'Counts:', " + ", ".join(f"'  {b}: ' || {b}" for b in ("total", *report.BUCKETS)) + ", '', 'Entries that need a look:') AS value FROM q "
    f"UNION ALL SELECT 1, {_PLACE}, '- ' || key || ': ' || status || chr(10) || '  confidence: ' || CAST(confidence AS VARCHAR) || chr(10) || '  reason: ' || reason || CASE WHEN st = 'matched' THEN chr(10) || '  title: update (crossref, ' || CAST(confidence AS VARCHAR) || ')' ELSE '' END FROM r WHERE status <> 'verified'"
)
def k_text_report(spark: SparkSession, d: str) -> DataFrame:
    return _shown(report.lines(_report(spark, d), "txt"))


@query(
    _RESULTS + f"SELECT 0 AS part, {_NOWHERE}, '{{\"type\":\"summary\",\"schema_version\":\"1.0\",\"complete\":' || complete || ',\"counts\":{{' || {_COUNTS_JSON} || '}}}}' AS value FROM q UNION ALL SELECT 1, {_PLACE}, '{{\"type\":\"entry\",' || {_ENTRY_JSON} FROM r"
)
def k_jsonl_report(spark: SparkSession, d: str) -> DataFrame:
    return _shown(report.lines(_report(spark, d), "jsonl"))


@query(
    _RESULTS + f"SELECT 0 AS part, {_NOWHERE}, '{{\"schema_version\":\"1.0\",\"complete\":' || complete || ',\"counts\":{{' || {_COUNTS_JSON} || '}}, \"entries\": [' AS value FROM q UNION ALL SELECT 2, {_NOWHERE}, ']}}' UNION ALL "
    f"SELECT 1, bucket_ord, pos, CASE WHEN row_number() OVER (ORDER BY bucket_ord, pos) = 1 THEN '' ELSE ', ' END || '{{' || j FROM (SELECT {_PLACE}, {_ENTRY_JSON} AS j FROM r)"
)
def k_json_report(spark: SparkSession, d: str) -> DataFrame:
    return _shown(report.lines(_report(spark, d), "json"))


@query(
    _RESULTS + f"SELECT 0 AS part, {_NOWHERE}, 'key,status,complete,confidence,reason,platform' AS value UNION ALL SELECT 1, {_PLACE}, concat_ws(',', key, status, CASE WHEN complete THEN 'True' ELSE 'False' END, CAST(confidence AS VARCHAR), '\"' || replace(reason, '\"', '\"\"') || '\"', platform) FROM r"
)
def k_csv_report(spark: SparkSession, d: str) -> DataFrame:
    return _shown(report.lines(_report(spark, d), "csv"))


@query(_RESULTS + "SELECT '1.0' AS schema_version, complete, " + ", ".join(("total", *report.BUCKETS)) + " FROM q")
def g_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.summary(_report(spark, d)).select("schema_version", "complete", "counts.*")


@query(sql.scored(_PAIRS, "case_id AS pos, CASE status WHEN 'matched' THEN 'verified' WHEN 'no_match' THEN 'not_found' ELSE status END AS bucket", "SELECT pos, bucket, CAST(list_position(['verified','updated','ambiguous','not_found','source_unavailable','identifier_conflict','invalid_input','errors'], bucket) AS INTEGER) AS bucket_ord FROM ({})"))
def w_bucket_order(spark: SparkSession, d: str) -> DataFrame:
    c = _assessed(spark, d, False)
    bucket = F.when(F.col("status") == "matched", "verified").when(F.col("status") == "no_match", "not_found").otherwise(F.col("status"))
    return report.ordered(c.select(F.col("case_id").alias("pos"), bucket.alias("bucket")), "pos")


_TTL = 168 * 3600  # the default of the settings


@query(
    f"WITH s AS (SELECT event_type || '-' || CAST(user_id % 40 AS VARCHAR) AS cache_key, event_id, epoch_us(ts) / 1e6 AS created FROM events), l AS (SELECT cache_key, arg_max(event_id, event_id) AS event_id, arg_max(created, event_id) AS created FROM s GROUP BY 1), "
    f"v AS (SELECT * FROM l WHERE epoch_us(TIMESTAMP '2024-02-01') / 1e6 - created <= {_TTL}), q AS (SELECT DISTINCT event_type || '-' || CAST(user_id % 60 AS VARCHAR) AS cache_key FROM events) "
    "SELECT q.cache_key, v.event_id, v.cache_key IS NOT NULL AS hit FROM q LEFT JOIN v ON v.cache_key = q.cache_key"
)
def s_cache_state(spark: SparkSession, d: str) -> DataFrame:
    """Requests met by a cache whose log is reduced to its state, at a fixed time."""
    e = read(spark, d, "events")
    key = lambda n: F.concat_ws("-", "event_type", (F.col("user_id") % n).cast("string")).alias("cache_key")
    # the stamp without a zone, as seconds since 1970 whatever the zone of the session
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6")
    state = lookup.latest(e.select(key(40), "event_id", at.alias("created")), "cache_key", ["event_id"])
    return lookup.cached(e.select(key(60)).distinct(), state, F.lit(1706745600.0), _TTL).select("cache_key", "event_id", "hit")


@query(
    "WITH r AS (SELECT source || '/' || coalesce(kind, '-') AS cache_key, doc_id, CASE WHEN doc_id % 3 = 0 THEN 503 ELSE 200 END AS status, text FROM documents WHERE source IS NOT NULL) "
    "SELECT cache_key, max(doc_id) AS created, arg_max(strlen(text), doc_id) AS body_bytes, 'content-type,etag' AS headers FROM r WHERE status BETWEEN 200 AND 299 AND text IS NOT NULL AND strlen(text) <= 10485760 GROUP BY 1"
)
def k_cache_put(spark: SparkSession, d: str) -> DataFrame:
    """Responses stored in an empty cache: successes of bounded size, the latest of each key."""
    docs = read(spark, d, "documents").where("source is not null")
    key = F.concat_ws("/", "source", F.coalesce("kind", F.lit("-")))
    headers = F.create_map(F.lit("ETag"), F.lit("x"), F.lit("Set-Cookie"), F.lit("secret"), F.lit("Content-Type"), F.lit("text"))
    answers = docs.select(key.alias("cache_key"), F.col("doc_id").alias("created"), F.when(F.col("doc_id") % 3 == 0, 503).otherwise(200).alias("status"), headers.alias("headers"), F.col("text").alias("body"))
    kept = lookup.put(answers.limit(0), answers)
    return kept.select("cache_key", "created", F.octet_length("body").cast("bigint").alias("body_bytes"), F.array_join(F.array_sort(F.transform(F.map_keys("headers"), lambda k: F.lower(k))), ",").alias("headers"))


@query(
    "WITH t AS (SELECT case_id, list_distinct(list_filter(string_split(" + sql.normalize("original.title") + ", ' '), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split(" + sql.normalize("candidate.title") + ", ' '), lambda w: w <> '')) AS b FROM cases WHERE original IS NOT NULL AND candidate IS NOT NULL) "
    "SELECT case_id, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_any, len(a) - len(list_intersect(a, b)) AS n_left FROM t"
)
def u_token_sets(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "cases").where("original is not null and candidate is not null")
    a, b = (similarity.tokens(text.normalize_native(f"{s}.title")) for s in ("original", "candidate"))
    n = lambda c: F.size(c).cast("bigint")
    return p.select("case_id", n(F.array_intersect(a, b)).alias("n_both"), n(F.array_union(a, b)).alias("n_any"), n(F.array_except(a, b)).alias("n_left"))


# ---- the whole engine -------------------------------------------------------------------------

_TABLES = {"crossref": "search_crossref", "openalex": "search_openalex", "semantic_scholar": "match_s2", "europe_pmc": "search_europepmc"}


def _verified(spark: SparkSession, d: str) -> tuple[Engine, DataFrame, DataFrame]:
    """The engine, the ``original`` sides of the cases as one list, and their results."""
    engine = Engine(spark, Settings(exact=False))
    own = {f: F.coalesce(F.col(f"original.{f}"), F.lit("")) for f in ("title", "author", "year", "doi")}
    c = read(spark, d, "cases").where("original is not null")
    entries = c.select(F.col("case_id").alias("pos"), F.col("citekey").alias("key"), F.lit("article").alias("entrytype"), *[own.get(f, F.lit("")).alias(f) for f in FIELDS], F.create_map().cast("map<string,string>").alias("extra"))
    return engine, entries, engine.verify(entries, {s: read(spark, d, t) for s, t in _TABLES.items()})


@query(sql.E_VERIFY)
def e_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every entry looked up in four sources, scored, selected, merged: bucket and decisions."""
    _, _, r = _verified(spark, d)
    return r.select("pos", "key", "bucket", "status", "complete", "confidence", "platform", "n_applied", "n_meaningful", _listed("providers").alias("providers"))


@query(sql.E_UPDATED)
def e_updated(spark: SparkSession, d: str) -> DataFrame:
    """The updated bibliography as text, an entry a row."""
    engine, entries, r = _verified(spark, d)
    return engine.updated(entries, r)


@query(sql.E_REVIEW)
def e_review(spark: SparkSession, d: str) -> DataFrame:
    """The entries that need a look, as they were given."""
    engine, entries, r = _verified(spark, d)
    return engine.review(entries, r)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
