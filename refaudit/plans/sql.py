"""SQL counterparts of the Column functions, for DuckDB."""

from __future__ import annotations

import html
import html.entities
import unicodedata

from refaudit.operators import merge, ranking, scoring
from refaudit.sources.adapters import ENTRY_FIELDS

DOI_SHAPE = r"(10\.\d{4,9}/[-._;()/:a-z0-9]+)"


def plain(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{{}}]', '', 'g'))"


def _unwrapped(x: str) -> str:
    return f"regexp_replace(regexp_replace({plain(x)}, '^doi\\s*:\\s*', '', 'i'), '^https?://(dx\\.)?doi\\.org/', '', 'i')"


def doi(x: str) -> str:
    u = _unwrapped(x)
    shaped = f"regexp_extract({u}, '{DOI_SHAPE}', 1, 'i')"
    return f"lower(rtrim(CASE WHEN {shaped} <> '' THEN {shaped} ELSE {u} END, '.,; '))"


def display_doi(x: str) -> str:
    return f"trim(trim(trim({_unwrapped(x)}), '.,; '))"


def pmid(x: str) -> str:
    return f"regexp_extract(regexp_replace({plain(x)}, '^pmid\\s*:\\s*', '', 'i'), '(\\d+)', 1)"


def pmcid(x: str) -> str:
    return f"regexp_extract(upper({plain(x)}), '(PMC\\d+)', 1)"


def arxiv(x: str) -> str:
    return f"lower(regexp_extract(replace({plain(x)}, '.pdf', ''), '(?:arxiv\\s*:\\s*|arxiv\\.org/(?:abs|pdf)/)?(\\d{{4}}\\.\\d{{4,5}}|[a-z.-]+/\\d{{7}})(?:v\\d+)?', 1, 'i'))"


def first(*xs: str) -> str:
    """The first text that is not empty."""
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def extract(rows: str, columns: str) -> str:
    """The identifiers of ``rows`` (doi, pmid, pmcid, eprint, url, note, howpublished and others)."""
    doi_in_text = f"lower(rtrim(regexp_extract(hay, '{DOI_SHAPE}', 1, 'i'), '.,; '))"
    pmid_in_text = r"regexp_extract(hay, '(?:pubmed\.ncbi\.nlm\.nih\.gov/|PMID\s*:?\s*)(\d+)', 1, 'i')"
    doi_of_arxiv = r"regexp_extract(d, '^10\.48550/arxiv\.(.+)$', 1)"
    return (
        f"WITH r AS ({rows}), h AS (SELECT *, {plain('url')} || ' ' || {plain('note')} || ' ' || {plain('howpublished')} AS hay FROM r), "
        f"i AS (SELECT *, {first(doi('doi'), doi_in_text)} AS d, {first(pmid('pmid'), pmid_in_text)} AS p, {first(pmcid('pmcid'), pmcid('hay'))} AS c, {first(arxiv('eprint'), arxiv('hay'))} AS a FROM h) "
        f"SELECT {columns}, d AS doi_form, p AS pmid_form, c AS pmcid_form, CASE WHEN a <> '' THEN a ELSE {arxiv(doi_of_arxiv)} END AS arxiv_form FROM i"
    )


def citation_key(family: str, year_: str, title: str, doi_: str) -> str:
    known = f"(coalesce({family}, '') || coalesce({year_}, '') || regexp_extract(coalesce({title}, ''), '([A-Za-z0-9]+)', 1))"
    raw = f"CASE WHEN {known} <> '' THEN {known} ELSE string_split({doi(doi_)}, '/')[-1] END"
    return f"coalesce(nullif(trim(regexp_replace({raw}, '[^A-Za-z0-9_:-]+', '_', 'g'), '_:-'), ''), 'crossref_entry')"


def json_text(x: str) -> str:
    """A JSON string in ASCII; characters beyond the first plane as two surrogates."""
    high = r"printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024)"
    short = r"""WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' WHEN c = chr(12) THEN '\f'"""
    one = rf"CASE {short} WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c)) ELSE {high} END"
    letters = f"list_transform(range(1, length({x}) + 1), lambda i: substr({x}, i, 1))"
    return f"""('"' || array_to_string(list_transform({letters}, lambda c: {one}), '') || '"')"""


WHITE = r"[\s\x{0B}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"
#: White space of the regular expressions of the JVM, which \s means there.
NOT_WORD = r"[^\p{L}\p{N}_\t\n\x{0B}\f\r ]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WHITE}', ' ', 'g'))"


def normalize(x: str) -> str:
    low = f"replace(lower(regexp_replace(regexp_replace(coalesce({x}, ''), '\\\\[a-zA-Z]+\\s*\\{{([^{{}}]*)\\}}', '\\1', 'g'), '[{{}}]', '', 'g')), 'ß', 'ss')"
    for k, v in (("α", " alpha "), ("β", " beta "), ("γ", " gamma ")):
        low = f"replace({low}, '{k}', '{v}')"
    return squeeze(f"regexp_replace({low}, '{NOT_WORD}', ' ', 'g')")


def clean(x: str) -> str:
    return squeeze(f"regexp_replace(coalesce({x}, ''), '[{{}}]', '', 'g')")


def comparable(x: str) -> str:
    return squeeze(f"regexp_replace(lower({clean(x)}), '{NOT_WORD}', '', 'g')")


def year(x: str) -> str:
    return f"TRY_CAST(regexp_extract(coalesce({x}, ''), '((?:19|20)\\d{{2}})', 1) AS INTEGER)"


def field_value(x: str, protect: bool = True) -> str:
    t = f"trim(coalesce({x}, ''))"
    body = f"trim(regexp_replace(regexp_replace({t}, '\\{{+', '{{', 'g'), '\\}}+', '}}', 'g'), '{{}}')"
    shown = f"'{{' || {body} || '}}'" if protect else body
    return f"CASE WHEN {t} = '' THEN '' ELSE {shown} END"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END"


def _families(x: str) -> str:
    parts = f"list_filter(regexp_split_to_array(coalesce({x}, ''), '(?i)\\s+and\\s+|\\s*;\\s*'), lambda p: trim(p) <> '')"
    fam = f"list_transform({parts}, lambda p: CASE WHEN contains(p, ',') THEN string_split(p, ',')[1] ELSE regexp_extract(rtrim(p), '(\\S+)$', 1) END)"
    return f"list_distinct(list_filter(list_transform({fam}, lambda f: {normalize('f')}), lambda f: f <> ''))"


def _with_signals(pairs: str) -> str:
    return (
        f"p AS ({pairs}), n AS (SELECT *, {normalize('o.title')} AS ot, {normalize('c.title')} AS ct, {_families('o.author')} AS oa, {_families('c.author')} AS ca, abs({year('o.\"year\"')} - {year('c.\"year\"')}) AS dy, {doi('o.doi')} AS od, {doi('c.doi')} AS cd FROM p), "
        "w AS (SELECT *, " + _tokens("ot") + " AS wo, " + _tokens("ct") + " AS wc, CASE WHEN length(ot) <= length(ct) THEN ot ELSE ct END AS sh, CASE WHEN length(ot) <= length(ct) THEN ct ELSE ot END AS lo FROM n), "
        f"s AS (SELECT *, CASE WHEN ot = '' OR ct = '' THEN 0.0 WHEN ot = ct THEN 1.0 ELSE greatest(coalesce({_jaccard('wo', 'wc')}, 0.0), CASE WHEN contains(lo, sh) AND len(string_split(sh, ' ')) >= 4 AND length(sh) / CAST(length(lo) AS DOUBLE) >= 0.65 THEN length(sh) / CAST(length(lo) AS DOUBLE) ELSE 0.0 END) END::DOUBLE AS title_sim, "
        f"{_jaccard('oa', 'ca')} AS author_sim, CASE WHEN dy = 0 THEN 1.0 WHEN dy = 1 THEN 0.65 WHEN dy IS NOT NULL THEN 0.0 END::DOUBLE AS year_sim FROM w)"
    )


def signals(pairs: str, columns: str) -> str:
    return f"WITH {_with_signals(pairs)} SELECT {columns} FROM s"


def _status_ctes(w: dict[str, float]) -> str:
    """CTEs from signals ``s`` to score and status ``e``."""
    return (
        f"a AS (SELECT *, (coalesce(CASE WHEN coalesce(o.title, '') <> '' AND coalesce(c.title, '') <> '' THEN title_sim * {w['title']}::DOUBLE END, 0) + coalesce(author_sim * {w['authors']}::DOUBLE, 0) + coalesce(year_sim * {w['year']}::DOUBLE, 0)) / nullif(CASE WHEN coalesce(o.title, '') <> '' AND coalesce(c.title, '') <> '' THEN {w['title']}::DOUBLE ELSE 0 END + CASE WHEN author_sim IS NOT NULL THEN {w['authors']}::DOUBLE ELSE 0 END + CASE WHEN year_sim IS NOT NULL THEN {w['year']}::DOUBLE ELSE 0 END, 0) AS weighted, "
        "(od <> '' AND cd <> '' AND od = cd) AS shared, (od <> '' AND cd <> '' AND od <> cd) AS clash FROM s), "
        "b AS (SELECT *, (shared AND ot <> '' AND ct <> '' AND title_sim < 0.45) AS other FROM a), "
        "d AS (SELECT *, CASE WHEN clash OR other THEN 0.0::DOUBLE WHEN shared THEN greatest(0.95::DOUBLE, coalesce(weighted, 1.0::DOUBLE)) ELSE coalesce(weighted, 0.0::DOUBLE) END AS score FROM b), "
        f"e AS (SELECT *, CASE WHEN clash OR other THEN 'identifier_conflict' WHEN NOT shared AND author_sim IS NULL AND year_sim IS NULL AND title_sim >= {scoring.AMBIGUOUS} THEN 'ambiguous' WHEN score >= {scoring.MATCHED} AND (title_sim >= 0.6 OR (shared AND ot = '' AND ct <> '')) THEN 'matched' WHEN score >= {scoring.AMBIGUOUS} OR (shared AND title_sim >= 0.45) THEN 'ambiguous' ELSE 'no_match' END AS status FROM d)"
    )


def scored(pairs: str, columns: str, outer: str = "{}") -> str:
    """The native score of pairs with title, author, year and doi, and what is made of it."""
    return outer.format(f"WITH {_with_signals(pairs)}, {_status_ctes(scoring.WEIGHTS)} SELECT {columns} FROM e")


def _t(x: str) -> str:
    return f"nullif(trim({x}), '')"


def _names(x: str) -> str:
    return f"nullif(trim(array_to_string(list_filter({x}, lambda n: coalesce(n, '') <> ''), ' and ')), '')"


_C = "CASE work_type WHEN 'journal-article' THEN 'article' WHEN 'book-chapter' THEN 'incollection' WHEN 'book' THEN 'book' WHEN 'proceedings-article' THEN 'inproceedings' WHEN 'posted-content' THEN 'unpublished' ELSE 'article' END"
_CT = field_value("container_title[1]")
A_CROSSREF = (
    f"SELECT rec_id, {_C} AS \"ENTRYTYPE\", {_t(field_value('title[1]'))} AS title, {_names("list_transform(list_filter(author, lambda a: a.family IS NOT NULL), lambda a: CASE WHEN a.given IS NOT NULL THEN a.family || ', ' || a.given ELSE a.family END)")} AS author, "
    f"CASE WHEN {_C} = 'article' THEN {_t(_CT)} END AS journal, CASE WHEN {_C} = 'inproceedings' THEN {_t(field_value('container_title[1]', False))} END AS booktitle, "
    "CAST(CASE WHEN published IS NOT NULL THEN published.\"date-parts\"[1][1] ELSE published_print.\"date-parts\"[1][1] END AS VARCHAR) AS year, "
    f"{_t('volume')} AS volume, {_t('issue')} AS number, {_t("replace(page, '-', '--')")} AS pages, {_t('publisher')} AS publisher, {_t('doi')} AS doi FROM search_crossref"
)
_OV = field_value("primary_location.source.display_name")
_O = _C.replace(" WHEN 'posted-content' THEN 'unpublished'", "")
A_OPENALEX = (
    f"SELECT rec_id, {_O} AS \"ENTRYTYPE\", {_t(field_value('title'))} AS title, {_names('list_transform(authorships, lambda a: a.author.display_name)')} AS author, "
    f"CASE WHEN {_O} = 'article' THEN {_t(_OV)} END AS journal, CASE WHEN {_O} = 'inproceedings' THEN {_t(_OV)} END AS booktitle, CAST(publication_year AS VARCHAR) AS year, {_t('biblio.volume')} AS volume, {_t('biblio.issue')} AS number, "
    f"{_t('CASE WHEN ' + _t('biblio.first_page') + ' IS NOT NULL AND ' + _t('biblio.last_page') + ' IS NOT NULL THEN biblio.first_page || \'--\' || biblio.last_page ELSE biblio.first_page END')} AS pages, "
    f"{_t("replace(doi, 'https://doi.org/', '')")} AS doi, {_t('host_organization.display_name')} AS publisher FROM search_openalex"
)
_K = "CASE WHEN list_contains(coalesce(publicationtypes, []), 'JournalArticle') THEN 'article' WHEN list_contains(coalesce(publicationtypes, []), 'Conference') THEN 'inproceedings' ELSE 'article' END"
A_S2 = (
    f"SELECT rec_id, {_K} AS \"ENTRYTYPE\", {_t(field_value('title'))} AS title, {_names('list_transform(authors, lambda a: a.name)')} AS author, CAST(pub_year AS VARCHAR) AS year, "
    f"coalesce({_t(field_value('journal.name'))}, CASE WHEN {_K} = 'article' THEN {_t(field_value('venue'))} END) AS journal, CASE WHEN {_K} = 'inproceedings' THEN {_t(field_value('venue'))} END AS booktitle, "
    f"coalesce({_t('doi')}, {_t('externalids.\"DOI\"')}) AS doi, {_t('externalids.\"ArXiv\"')} AS eprint, CASE WHEN externalids.\"ArXiv\" IS NOT NULL THEN 'arXiv' END AS archiveprefix, {_t('externalids.\"PubMed\"')} AS pmid FROM match_s2"
)
A_EPMC = (
    f"SELECT rec_id, 'article' AS \"ENTRYTYPE\", {_t(field_value('title'))} AS title, CASE WHEN authorstring <> '' THEN {_t("replace(authorstring, ', ', ' and ')")} END AS author, {_t('pubyear')} AS year, "
    f"{_t(field_value('journaltitle'))} AS journal, {_t('journalvolume')} AS volume, {_t('issue')} AS number, {_t("replace(pageinfo, '-', '--')")} AS pages, {_t('doi')} AS doi, {_t('pmid')} AS pmid, {_t('pmcid')} AS pmcid FROM search_europepmc"
)

_E_AUTHORS = _names("string_split(authorstring, ', ')")
A_PUBMED = (
    f"SELECT rec_id, 'article' AS \"ENTRYTYPE\", {_t(field_value('title'))} AS title, {_E_AUTHORS} AS author, regexp_extract(coalesce(pubyear, '') || ' Jan 3', '(\\d{{4}})', 1) AS y, {_t(field_value('journaltitle'))} AS journal, {_t('journalvolume')} AS volume, "
    f"{_t('issue')} AS number, {_t("replace(pageinfo, '-', '--')")} AS pages, {_t('doi')} AS doi, {_t('pmid')} AS pmid, {_t('pmcid')} AS pmcid FROM search_europepmc"
)
A_PUBMED = f"SELECT * EXCLUDE (y), nullif(y, '') AS year FROM ({A_PUBMED})"
_D = "CASE work_type WHEN 'book-chapter' THEN 'incollection' WHEN 'proceedings-article' THEN 'inproceedings' ELSE 'article' END"
_DN = _names("list_transform(authorships, lambda a: a.author.display_name)")
A_DBLP = (
    f"SELECT rec_id, {_D} AS \"ENTRYTYPE\", {_t(field_value('title'))} AS title, {_DN} AS author, CAST(publication_year AS VARCHAR) AS year, CASE WHEN {_D} = 'article' THEN {_t(_OV)} END AS journal, CASE WHEN {_D} = 'inproceedings' THEN {_t(_OV)} END AS booktitle, "
    f"{_t('biblio.volume')} AS volume, {_t("replace(biblio.first_page || '-' || biblio.last_page, '-', '--')")} AS pages, {_t('doi')} AS doi, {_t('work_url')} AS url FROM search_openalex"
)
A_CORE = (
    f"SELECT rec_id, 'article' AS \"ENTRYTYPE\", {_t(field_value('title'))} AS title, {_names('list_transform(authors, lambda a: a.name)')} AS author, CAST(coalesce(pub_year, 1999) AS VARCHAR) AS year, "
    f"{_t(field_value('venue'))} AS journal, {_t('doi')} AS doi, 'https://core.example/' || CAST(rec_id AS VARCHAR) AS url FROM match_s2"
)
_BN = _names("list_transform(string_split(array_to_string(list_filter(list_transform(authorships, lambda a: a.author.display_name), lambda n: coalesce(n, '') <> ''), '; '), ';'), lambda n: trim(n))")
A_BIORXIV = (
    f"SELECT rec_id, 'article' AS \"ENTRYTYPE\", {_t(field_value('title'))} AS title, CASE WHEN authorships IS NOT NULL THEN CASE WHEN rec_id % 3 = 0 THEN {_BN} ELSE {_DN} END END AS author, CAST(publication_year AS VARCHAR) AS year, "
    f"coalesce({_t(_OV)}, '{{bioRxiv}}') AS journal, {_t('doi')} AS doi, coalesce(CASE WHEN rec_id % 2 = 0 THEN {_t('work_url')} END, 'https://x.example/' || CAST(rec_id AS VARCHAR)) AS url, 'Version 2' AS note, {_t('work_type')} AS keywords FROM search_openalex"
)
A_ARXIV = (
    f"SELECT rec_id, 'article' AS \"ENTRYTYPE\", {_t(field_value('title'))} AS title, {_DN} AS author, CAST(publication_year AS VARCHAR) AS year, CAST(rec_id AS VARCHAR) || '.0001v2' AS eprint, 'arXiv' AS archiveprefix, 'cs.DL' AS primaryclass, "
    f"coalesce({_t(_OV)}, '{{arXiv}}') AS journal, {_t('doi')} AS doi FROM search_openalex"
)

_on = [(n, p) for n, p, on in ranking.SOURCES if on]
R_RANK = (
    "WITH h AS (SELECT rec_id, coalesce(doi, '') <> '' AS has_doi, " + doi("doi") + " AS d, lower(concat_ws(' ', coalesce(container_title[1], ''), coalesce(publisher, ''), coalesce(title[1], ''))) AS hay FROM search_crossref), "
    f"m AS (SELECT *, regexp_matches(hay, '{'|'.join(ranking.BIOMEDICAL)}') AS bio, regexp_matches(hay, '{'|'.join(ranking.COMPUTING)}') AS cs, starts_with(d, '10.48550/arxiv.') AS arx FROM h), "
    "x AS (SELECT rec_id, n AS source, pos, CASE WHEN has_doi AND n = 'crossref' THEN -100 WHEN arx AND n = 'arxiv' THEN -90 WHEN bio AND n = 'pubmed' THEN -80 WHEN bio AND n = 'europe_pmc' THEN -70 WHEN cs AND n = 'dblp' THEN -60 WHEN bio AND n = 'biorxiv' THEN -30 ELSE 0 END AS boost "
    f"FROM m, (VALUES {', '.join(f"('{n}', {p})" for n, p in _on)}) t(n, pos)) "
    "SELECT rec_id, source, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY boost, pos) AS INTEGER) AS rank FROM x"
)


def _events(status: dict[str, str]) -> str:
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in status.items())
    return (
        f"r AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS entry, event_id, CASE event_type {case} END AS source_status, round(value % 1, 2) AS score FROM events), "
        "q AS (SELECT entry, source_status, score, row_number() OVER (PARTITION BY entry ORDER BY event_id) AS rank, 's' || CAST(row_number() OVER (PARTITION BY entry ORDER BY event_id) AS VARCHAR) AS source FROM r)"
    )


def w_select(status: dict[str, str]) -> str:
    return (
        f"WITH {_events(status)}, k AS (SELECT entry, source_status AS st, score, rank AS cand_pos FROM q WHERE source_status <> 'network_error'), c AS (SELECT *, bool_or(st = 'identifier_conflict') OVER (PARTITION BY entry) AS conf FROM k), "
        "v AS (SELECT *, CASE WHEN conf THEN st = 'identifier_conflict' ELSE st IN ('matched', 'ambiguous') END AS viable FROM c), "
        "n AS (SELECT *, row_number() OVER w AS rn, lead(CASE WHEN viable THEN score END) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY entry ORDER BY viable DESC, CASE WHEN conf THEN 0.0 ELSE score END DESC, cand_pos)) "
        f"SELECT entry, CASE WHEN conf THEN 'identifier_conflict' WHEN NOT viable THEN 'no_match' WHEN nxt IS NOT NULL AND score - nxt <= {scoring.MARGIN}::DOUBLE THEN 'ambiguous' ELSE st END AS source_status, CASE WHEN viable THEN score END AS score, CAST(CASE WHEN viable THEN cand_pos END AS INTEGER) AS cand_pos FROM n WHERE rn = 1"
    )


def w_consulted(status: dict[str, str], tail: str) -> str:
    ends = "source_status = 'identifier_conflict'" if "walked" not in tail or "GROUP BY entry" in tail else "source_status IN ('identifier_conflict', 'matched')"
    return (
        f"WITH {_events(status)}, b AS (SELECT *, coalesce(bool_or({ends}) OVER (PARTITION BY entry ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_ FROM q), "
        f"walked AS (SELECT entry, source, rank, source_status, score FROM b WHERE NOT over_) {tail}"
    )


_UN = ", ".join(f"'{u}'" for u in ranking.UNAVAILABLE)
_OUTCOME_CTES = (
    "g AS (SELECT entry, bool_or(source_status = 'identifier_conflict') AS c, bool_or(source_status = 'matched') AS m, bool_or(source_status = 'ambiguous') AS a, "
    f"bool_or(source_status IN ({_UN})) AS u, bool_or(source_status = 'no_match') AS n, string_agg(source || '=' || source_status, ',' ORDER BY rank) AS providers FROM walked GROUP BY entry), "
    "t AS (SELECT *, CASE WHEN c THEN 'identifier_conflict' WHEN m THEN 'verified' WHEN a THEN 'ambiguous' WHEN u THEN 'source_unavailable' WHEN n THEN 'not_found' ELSE 'invalid_input' END AS status FROM g), "
    "z AS (SELECT w.entry, w.source, w.score, row_number() OVER (PARTITION BY w.entry ORDER BY coalesce(w.score, 0) DESC, w.rank) AS rn FROM walked w JOIN t ON t.entry = w.entry AND w.source_status = CASE t.status WHEN 'verified' THEN 'matched' ELSE t.status END WHERE t.status IN ('identifier_conflict', 'verified', 'ambiguous')), "
    "outcome AS (SELECT t.entry, t.status, z.source, z.score, CASE WHEN t.c OR t.m OR t.a THEN NOT t.u WHEN t.u THEN false ELSE t.n END AS complete, t.providers FROM t LEFT JOIN z ON z.entry = t.entry AND z.rn = 1)"
)
OUTCOME = f", {_OUTCOME_CTES} SELECT * FROM outcome"
_P = "SELECT case_id, expected, bibliography, original AS o, candidate AS c FROM cases WHERE original IS NOT NULL AND candidate IS NOT NULL"
G_COUNTS = scored(
    _P, "CASE WHEN status = 'matched' THEN CASE WHEN score < 1 THEN 'updated' ELSE 'verified' END WHEN status = 'no_match' THEN 'not_found' ELSE status END AS bucket",
    "SELECT CAST(count_if(bucket = 'verified') AS BIGINT) AS verified, CAST(count_if(bucket = 'updated') AS BIGINT) AS updated, CAST(count_if(bucket = 'ambiguous') AS BIGINT) AS ambiguous, CAST(count_if(bucket = 'not_found') AS BIGINT) AS not_found, CAST(count_if(bucket = 'source_unavailable') AS BIGINT) AS source_unavailable, CAST(count_if(bucket = 'identifier_conflict') AS BIGINT) AS identifier_conflict, CAST(count_if(bucket = 'invalid_input') AS BIGINT) AS invalid_input, CAST(count_if(bucket = 'errors') AS BIGINT) AS errors, count(*) AS total FROM ({})",
)


def _acted(keys: str) -> str:
    """CTEs from ``l`` (keys, conf, field, original, suggested) to ``acted``."""
    case = "CASE WHEN field = 'doi' THEN {d} WHEN field = 'pmid' THEN {p} WHEN field = 'pmcid' THEN {c} WHEN field = 'eprint' THEN {a} WHEN field IN ('year', 'volume', 'number') THEN {n} ELSE {t} END"
    form = lambda x: case.format(d=doi(x), p=pmid(x), c=pmcid(x), a=f"coalesce(nullif({arxiv(x)}, ''), {normalize(x)})", n=f"regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g')", t=normalize(x))
    cons = ", ".join(f"'{f}'" for f in merge.CONSERVATIVE_FIELDS)
    return (
        f"m AS (SELECT {keys}, conf, field, original, suggested, {form('original')} = {form('suggested')} AS normalized_equal FROM l WHERE suggested <> ''), "
        f"acted AS (SELECT *, CASE WHEN normalized_equal AND original <> '' THEN 'keep_original' WHEN original = '' THEN CASE WHEN conf >= {merge.THRESHOLD} THEN 'add' ELSE 'suggest' END WHEN field IN ('doi', 'pmid', 'pmcid', 'eprint') THEN 'manual_review' WHEN field IN ({cons}) AND conf >= {merge.THRESHOLD} THEN 'update' ELSE 'suggest' END AS action FROM m)"
    )


def decisions(tail: str) -> str:
    return (
        "WITH p AS (SELECT case_id, original AS o, candidate AS c, CASE WHEN expected = 'matched' THEN 0.95 ELSE 0.80 END AS conf FROM cases WHERE original IS NOT NULL AND candidate IS NOT NULL), "
        "l AS (SELECT case_id, conf, f AS field, trim(coalesce(CASE f WHEN 'title' THEN o.title WHEN 'author' THEN o.author WHEN 'year' THEN o.\"year\" ELSE o.doi END, '')) AS original, trim(coalesce(CASE f WHEN 'title' THEN c.title WHEN 'author' THEN c.author WHEN 'year' THEN c.\"year\" ELSE c.doi END, '')) AS suggested FROM p, (VALUES ('title'), ('author'), ('year'), ('doi')) t(f)), "
        f"{_acted('case_id')} {tail}"
    )


# ---- what the exact forms need ----------------------------------------------------------------


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _compatibility() -> dict[str, str]:
    """Characters whose compatibility form is another text, by rule, in the blocks that occur."""
    blocks = ((0xA0, 0x250), (0x2B0, 0x300), (0x2000, 0x2190), (0x2460, 0x2500), (0x3000, 0x3100), (0xFB00, 0xFB07), (0xFF01, 0xFFE7), (0x1D400, 0x1D500))
    return {chr(o): k for a, b in blocks for o in range(a, b) if (k := unicodedata.normalize("NFKC", chr(o))) != unicodedata.normalize("NFC", chr(o))}


def _escapes() -> dict[str, str]:
    """HTML escapes by name, and the numbers that stand for characters of the Windows code page."""
    names = {f"&{n};": chr(o) for n, o in html.entities.name2codepoint.items()}
    return names | {f"&#{o};": html.unescape(f"&#{o};") for o in range(128, 160)}


def normalized(rows: str) -> str:
    """CTEs from ``rows`` (id, x) to ``normal`` (id, t): escapes, compatibility forms, case, words."""
    table = lambda d: ", ".join(f"({_literal(k)}, {_literal(v)})" for k, v in d.items())
    low = r"replace(replace(replace(replace(replace(lower(nfc_normalize(y)), 'ß', 'ss'), 'ς', 'σ'), 'α', ' alpha '), 'β', ' beta '), 'γ', ' gamma ')"
    return (
        f"texts AS ({rows}), esc(k, v) AS (VALUES {table(_escapes())}), compat(k, v) AS (VALUES {table(_compatibility())}), "
        r"tokens AS (SELECT id, unnest(regexp_extract_all(coalesce(x, ''), '&#?\w+;|[^&]+|&')) AS w, generate_subscripts(regexp_extract_all(coalesce(x, ''), '&#?\w+;|[^&]+|&'), 1) AS n FROM texts), "
        r"plainer AS (SELECT t.id, string_agg(coalesce(e.v, CASE WHEN regexp_full_match(w, '&#\d+;') THEN chr(CAST(regexp_extract(w, '\d+') AS INTEGER)) END, w), '' ORDER BY n) AS x FROM tokens t LEFT JOIN esc e ON e.k = t.w GROUP BY t.id), "
        r"untexed AS (SELECT id, regexp_replace(regexp_replace(x, '\\[a-zA-Z]+\s*\{([^{}]*)\}', '\1', 'g'), '[{}]', '', 'g') AS x FROM plainer), "
        "letters AS (SELECT id, unnest(range(1, length(x) + 1)) AS n, x FROM untexed), "
        "compatible AS (SELECT l.id, string_agg(coalesce(c.v, substr(l.x, l.n, 1)), '' ORDER BY n) AS y FROM letters l LEFT JOIN compat c ON c.k = substr(l.x, l.n, 1) GROUP BY l.id), "
        f"normal AS (SELECT t.id, coalesce({squeeze(f"regexp_replace({low}, '{NOT_WORD}', ' ', 'g')")}, '') AS t FROM texts t LEFT JOIN compatible c ON c.id = t.id)"
    )


def ratios(rows: str) -> str:
    """CTEs from ``rows`` (id, a, b) to ``ratio`` (id, r): twice the letters in matching blocks over
    all letters, where the longest common block (the first in a, then in b) splits both texts and
    the parts on either side are compared in the same way. Texts of under 200 letters."""
    shift = "greatest(0, x.alo - u.i, x.blo - u.j)"
    size = f"least(u.n - {shift}, x.ahi - u.i - {shift}, x.bhi - u.j - {shift})"
    return (
        f"rp AS ({rows}), ra AS (SELECT id, i, substr(a, i + 1, 1) AS c FROM (SELECT id, a, unnest(range(length(a))) AS i FROM rp)), rb AS (SELECT id, j, substr(b, j + 1, 1) AS c FROM (SELECT id, b, unnest(range(length(b))) AS j FROM rp)), "
        "same AS (SELECT ra.id, i, j, i - row_number() OVER (PARTITION BY ra.id, i - j ORDER BY i) AS g FROM ra JOIN rb ON ra.id = rb.id AND ra.c = rb.c), "
        "runs AS (SELECT id, min(i) AS i, min(j) AS j, count(*) AS n FROM same GROUP BY id, i - j, g), "
        "parts(id, alo, ahi, blo, bhi, n) AS (SELECT id, 0::BIGINT, length(a)::BIGINT, 0::BIGINT, length(b)::BIGINT, 0::BIGINT FROM rp UNION ALL "
        "SELECT id, unnest([alo, best.i + best.n]), unnest([best.i, ahi]), unnest([blo, best.j + best.n]), unnest([best.j, bhi]), unnest([best.n, 0]) FROM ("
        f"SELECT x.id, x.alo, x.ahi, x.blo, x.bhi, arg_max({{'i': u.i + {shift}, 'j': u.j + {shift}, 'n': {size}}}, [{size}, -(u.i + {shift}), -(u.j + {shift})]) AS best "
        f"FROM parts x JOIN runs u ON u.id = x.id WHERE x.alo < x.ahi AND x.blo < x.bhi AND {size} > 0 GROUP BY x.id, x.alo, x.ahi, x.blo, x.bhi)), "
        "ratio AS (SELECT rp.id, 2.0::DOUBLE * sum(n) / max(length(a) + length(b)) AS r FROM rp JOIN parts ON parts.id = rp.id GROUP BY rp.id)"
    )


def assessed(tail: str) -> str:
    """The exact score of the labelled pairs with title, author, year and doi, and ``tail``."""
    w = scoring.WEIGHTS
    families = (
        "fam AS (SELECT id, side, f, row_number() OVER () AS k FROM (SELECT case_id AS id, side, unnest(list_transform(list_filter(regexp_split_to_array(coalesce(a, ''), '(?i)\\s+and\\s+|\\s*;\\s*'), lambda p: trim(p) <> ''), "
        "lambda p: CASE WHEN contains(p, ',') THEN string_split(p, ',')[1] ELSE regexp_extract(rtrim(p), '(\\S+)$', 1) END)) AS f FROM (SELECT case_id, 'o' AS side, o.author AS a FROM p UNION ALL SELECT case_id, 'c', c.author FROM p)))"
    )
    return (
        f"WITH RECURSIVE p AS (SELECT case_id, expected, original AS o, candidate AS c FROM cases WHERE original IS NOT NULL AND candidate IS NOT NULL), {families}, "
        + normalized("SELECT 'o' || case_id AS id, o.title AS x FROM p UNION ALL SELECT 'c' || case_id, c.title FROM p UNION ALL SELECT 'f' || k, f FROM fam")
        + ", fams AS (SELECT id, list(DISTINCT t) FILTER (side = 'o' AND t <> '') AS oa, list(DISTINCT t) FILTER (side = 'c' AND t <> '') AS ca FROM (SELECT fam.id, side, n.t FROM fam JOIN normal n ON n.id = 'f' || fam.k) GROUP BY id), "
        f"t AS (SELECT p.*, a.t AS ot, b.t AS ct, coalesce(f.oa, []) AS oa, coalesce(f.ca, []) AS ca, abs({year('o.\"year\"')} - {year('c.\"year\"')}) AS dy, {doi('o.doi')} AS od, {doi('c.doi')} AS cd FROM p JOIN normal a ON a.id = 'o' || case_id JOIN normal b ON b.id = 'c' || case_id LEFT JOIN fams f ON f.id = case_id), "
        + ratios("SELECT case_id AS id, ot AS a, ct AS b FROM t WHERE ot <> ct AND ot <> '' AND ct <> ''")
        + ", w AS (SELECT t.*, coalesce(r.r, 0) AS rat, " + _tokens("ot") + " AS wo, " + _tokens("ct") + " AS wc, CASE WHEN length(ot) <= length(ct) THEN ot ELSE ct END AS sh, CASE WHEN length(ot) <= length(ct) THEN ct ELSE ot END AS lo FROM t LEFT JOIN ratio r ON r.id = case_id), "
        f"s AS (SELECT *, CASE WHEN ot = '' OR ct = '' THEN 0.0 WHEN ot = ct THEN 1.0 ELSE greatest(rat, coalesce({_jaccard('wo', 'wc')}, 0.0), CASE WHEN contains(lo, sh) AND len(string_split(sh, ' ')) >= 4 AND length(sh) / CAST(length(lo) AS DOUBLE) >= 0.65 THEN length(sh) / CAST(length(lo) AS DOUBLE) ELSE 0.0 END) END::DOUBLE AS title_sim, "
        f"{_jaccard('oa', 'ca')} AS author_sim, CASE WHEN dy = 0 THEN 1.0 WHEN dy = 1 THEN 0.65 WHEN dy IS NOT NULL THEN 0.0 END::DOUBLE AS year_sim FROM w), {_status_ctes(w)} {tail}"
    )


def top_titles(limit: int = 5) -> str:
    """CTEs from ``asked`` (e, t) and ``held`` (r, t) to ``top`` (e, r, shared, rank)."""
    words = "SELECT {k}, unnest(list_distinct(list_filter(string_split(t, ' '), lambda w: w <> ''))) AS w FROM {d}"
    size = "(SELECT {k}, w, count(*) OVER (PARTITION BY {k}) AS n FROM ({x}))"
    a = size.format(k="e", x=words.format(k="e", d="asked"))
    b = size.format(k="r", x=words.format(k="r", d="held"))
    return (
        f"paired AS (SELECT a.e, b.r, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM {a} a JOIN {b} b ON a.w = b.w GROUP BY a.e, b.r), "
        f"top AS (SELECT e, r, shared, row_number() OVER (PARTITION BY e ORDER BY shared / CAST(na + nb - shared AS DOUBLE) DESC, r) AS rank FROM paired QUALIFY rank <= {limit})"
    )


_TABLES = {"crossref": A_CROSSREF, "openalex": A_OPENALEX, "semantic_scholar": A_S2, "europe_pmc": A_EPMC}
_SUGGESTED = ("title", "author", "journal", "booktitle", "year", "volume", "number", "pages", "publisher", "doi", "pmid", "pmcid", "eprint", "archiveprefix", "ENTRYTYPE")


def engine(tail: str) -> str:
    """The whole verification of the ``original`` sides of the cases against four tables, in the
    native form, and ``tail``."""
    number = {n: i for i, n in enumerate(_TABLES)}
    rec = " UNION ALL BY NAME ".join(f"SELECT '{n}' AS source, {i} AS nr, * FROM ({_TABLES[n]})" for n, i in number.items())
    prefixed = "array_to_string(list_transform(string_split(t, ' '), lambda w: nr || ':' || w), ' ')"
    boost = "CASE WHEN coalesce(o.doi, '') <> '' AND n = 'crossref' THEN -100 WHEN starts_with(d, '10.48550/arxiv.') AND n = 'arxiv' THEN -90 WHEN bio AND n = 'pubmed' THEN -80 WHEN bio AND n = 'europe_pmc' THEN -70 WHEN cs AND n = 'dblp' THEN -60 WHEN bio AND n = 'biorxiv' THEN -30 ELSE 0 END"
    names = ", ".join(f"'{n}'" for n in _TABLES)
    pairs = "SELECT se.pos, rk.source, rk.rec_id, se.o, {'title': rk.title, 'author': rk.author, 'year': rk.\"year\", 'doi': rk.doi} AS c FROM (SELECT * FROM hit UNION ALL SELECT e // 10, e % 10, r // 10 FROM top) h JOIN se ON se.pos = h.pos JOIN rk ON rk.nr = h.nr AND rk.rec_id = h.rec_id"
    given = "CASE f WHEN 'title' THEN o.title WHEN 'author' THEN o.author WHEN 'year' THEN o.\"year\" WHEN 'doi' THEN o.doi WHEN 'ENTRYTYPE' THEN 'article' ELSE '' END"
    suggested = "CASE f " + " ".join(f"WHEN '{f}' THEN \"{f}\"" for f in _SUGGESTED) + " END"
    return (
        f"WITH en AS (SELECT case_id AS pos, citekey AS key, original AS o, {doi('original.doi')} AS d, {normalize('original.title')} AS t, trim(coalesce(original.title, '')) <> '' AS titled FROM cases WHERE original IS NOT NULL), "
        "dup AS (SELECT key FROM en WHERE key IS NOT NULL GROUP BY 1 HAVING count(*) > 1), bad AS (SELECT pos FROM en WHERE trim(coalesce(key, '')) = '' OR key IN (SELECT key FROM dup)), "
        f"se AS (SELECT * FROM en WHERE pos NOT IN (SELECT pos FROM bad) AND (titled OR d <> '')), rec AS ({rec}), rk AS (SELECT *, {doi('doi')} AS d, {normalize('title')} AS t FROM rec), "
        "hit AS (SELECT pos, nr, rec_id FROM (SELECT se.pos, rk.nr, rk.source, rk.rec_id, row_number() OVER (PARTITION BY se.pos, rk.nr ORDER BY rk.rec_id) AS n FROM se JOIN rk ON se.d = rk.d WHERE se.d <> '') WHERE n <= CASE WHEN source IN ('crossref', 'semantic_scholar') THEN 1 ELSE 5 END), "
        f"asked AS (SELECT se.pos * 10 + nr AS e, {prefixed} AS t FROM se, (SELECT DISTINCT nr, source FROM rk) x WHERE titled AND t <> '' AND (d = '' OR source IN ('crossref', 'semantic_scholar')) AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.pos = se.pos AND hit.nr = x.nr)), "
        f"held AS (SELECT rec_id * 10 + nr AS r, {prefixed} AS t FROM rk WHERE t <> ''), {top_titles()}, {_with_signals(pairs)}, {_status_ctes(scoring.WEIGHTS)}, "
        "c1 AS (SELECT pos, source, rec_id AS cand_pos, status AS st, score, bool_or(status = 'identifier_conflict') OVER (PARTITION BY pos, source) AS conf FROM e), v1 AS (SELECT *, CASE WHEN conf THEN st = 'identifier_conflict' ELSE st IN ('matched', 'ambiguous') END AS viable FROM c1), "
        "n1 AS (SELECT *, row_number() OVER w1 AS rn, lead(CASE WHEN viable THEN score END) OVER w1 AS nxt FROM v1 WINDOW w1 AS (PARTITION BY pos, source ORDER BY viable DESC, CASE WHEN conf THEN 0.0 ELSE score END DESC, cand_pos)), "
        f"sel AS (SELECT pos, source, CASE WHEN conf THEN 'identifier_conflict' WHEN NOT viable THEN 'no_match' WHEN nxt IS NOT NULL AND score - nxt <= {scoring.MARGIN}::DOUBLE THEN 'ambiguous' ELSE st END AS source_status, CASE WHEN viable THEN score END AS score, CASE WHEN viable THEN cand_pos END AS cand_pos FROM n1 WHERE rn = 1), "
        f"hay AS (SELECT *, regexp_matches(lower(coalesce(o.title, '')), '{'|'.join(ranking.BIOMEDICAL)}') AS bio, regexp_matches(lower(coalesce(o.title, '')), '{'|'.join(ranking.COMPUTING)}') AS cs FROM se), "
        f"rr AS (SELECT pos, n AS source, row_number() OVER (PARTITION BY pos ORDER BY {boost}, prio) AS rank FROM hay, (VALUES {', '.join(f"('{n}', {p})" for n, p in _on)}) x(n, prio)), "
        f"res AS (SELECT rr.pos AS entry, rr.source, rr.rank, coalesce(sel.source_status, CASE WHEN rr.source IN ({names}) THEN 'no_match' ELSE 'skipped' END) AS source_status, sel.score, sel.cand_pos FROM rr LEFT JOIN sel ON sel.pos = rr.pos AND sel.source = rr.source), "
        "walk AS (SELECT *, coalesce(bool_or(source_status IN ('identifier_conflict', 'matched')) OVER (PARTITION BY entry ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_ FROM res), "
        f"walked AS (SELECT * FROM walk WHERE NOT over_), {_OUTCOME_CTES}, "
        f"l AS (SELECT pos, conf, f AS field, trim(coalesce({given}, '')) AS original, trim(coalesce({suggested}, '')) AS suggested FROM (SELECT se.pos, se.o, oc.score AS conf, rk.* EXCLUDE (d, t) FROM outcome oc JOIN se ON se.pos = oc.entry JOIN res ON res.entry = oc.entry AND res.source = oc.source JOIN rk ON rk.source = oc.source AND rk.rec_id = res.cand_pos WHERE oc.status = 'verified') x, (VALUES {', '.join(f"('{f}')" for f in _SUGGESTED)}) y(f)), "
        f"{_acted('pos')}, merged AS (SELECT pos, CAST(count_if(action IN ('add', 'update')) AS BIGINT) AS n_applied, CAST(count_if(NOT normalized_equal AND action <> 'keep_original') AS BIGINT) AS n_meaningful FROM acted GROUP BY 1), "
        "final AS (SELECT en.pos, en.key, en.o, oc.score, oc.source, oc.complete, oc.providers, merged.n_applied, merged.n_meaningful, bad.pos IS NOT NULL AS invalid, oc.status = 'verified' AND coalesce(n_meaningful, 0) > 0 AS changed, oc.status AS st FROM en LEFT JOIN outcome oc ON oc.entry = en.pos LEFT JOIN merged ON merged.pos = en.pos LEFT JOIN bad ON bad.pos = en.pos), "
        "verdict AS (SELECT *, CASE WHEN invalid THEN NULL WHEN changed THEN 'metadata_mismatch' ELSE coalesce(st, 'invalid_input') END AS status, CASE WHEN invalid THEN 'invalid_input' WHEN changed THEN 'updated' ELSE coalesce(st, 'invalid_input') END AS bucket FROM final) "
        f"{tail}"
    )


E_VERIFY = engine("SELECT pos, key, bucket, status, coalesce(complete, false) AS complete, round(score, 4) AS confidence, CASE WHEN st = 'verified' THEN source END AS platform, n_applied, n_meaningful, providers FROM verdict")
_OWN = "(VALUES (1, 'title'), (2, 'author'), (9, 'year'), (19, 'doi')) f(ord, field)"
_VALUE = "CASE field WHEN 'title' THEN o.title WHEN 'author' THEN o.author WHEN 'year' THEN o.\"year\" ELSE o.doi END"
_PLACES = [f for f in ENTRY_FIELDS if f in _SUGGESTED] + sorted(f for f in _SUGGESTED if f not in ENTRY_FIELDS and f != "ENTRYTYPE")
_ENTRY = "replace('@' || {kind} || '{{' || coalesce(key, '') || coalesce({lines}, '') || chr(10) || '}}' || chr(10), 'arXiv (Cornell University)', 'arXiv') AS bibtex"
_LINES = "string_agg(',' || chr(10) || '  ' || field || ' = {' || trim(v) || '}', '' ORDER BY ord)"
E_UPDATED = engine(
    f", places AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}')" for i, f in enumerate(_PLACES))}) f(ord, field)), applied AS (SELECT a.pos, a.field, a.suggested FROM acted a JOIN verdict USING (pos) WHERE action IN ('add', 'update') AND bucket = 'updated'), "
    f"full_ AS (SELECT x.pos, ord, x.field, coalesce(applied.suggested, {_VALUE.replace('ELSE o.doi', "WHEN 'doi' THEN o.doi").replace('field', 'x.field')}) AS v FROM (SELECT * FROM en, places) x LEFT JOIN applied ON applied.pos = x.pos AND applied.field = x.field), "
    f"lines AS (SELECT pos, {_LINES} AS body FROM full_ WHERE trim(coalesce(v, '')) <> '' GROUP BY pos) "
    f"SELECT en.pos, {_ENTRY.format(kind="coalesce(k.suggested, 'article')", lines='body')} FROM en LEFT JOIN lines ON lines.pos = en.pos LEFT JOIN applied k ON k.pos = en.pos AND k.field = 'ENTRYTYPE'"
)
_BUCKETS = "['verified', 'updated', 'ambiguous', 'not_found', 'source_unavailable', 'identifier_conflict', 'invalid_input', 'errors']"
E_REVIEW = engine(
    f", own AS (SELECT pos, ord, field, {_VALUE} AS v FROM en, {_OWN}), lines AS (SELECT pos, {_LINES} AS body FROM own WHERE trim(coalesce(v, '')) <> '' GROUP BY pos) "
    f"SELECT CAST(list_position({_BUCKETS}, bucket) AS INTEGER) AS bucket_ord, verdict.pos, {_ENTRY.format(kind="'article'", lines='body')} FROM verdict LEFT JOIN lines ON lines.pos = verdict.pos WHERE bucket NOT IN ('verified', 'updated')"
)
