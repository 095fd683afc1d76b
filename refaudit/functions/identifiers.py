"""Canonical forms of scholarly identifiers as plain Column expressions.

Every function returns ``''`` for null or for "no such identifier", so that results can be
compared without null handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shapes of the identifiers.
DOI_SHAPE = r"(?i)10\.\d{4,9}/[-._;()/:a-z0-9]+"
ARXIV_SHAPE = r"(?i)(?:arxiv\s*:\s*|arxiv\.org/(?:abs|pdf)/)?(\d{4}\.\d{4,5}|[a-z.-]+/\d{7})(?:v\d+)?"
PMID_IN_TEXT = r"(?i)(?:pubmed\.ncbi\.nlm\.nih\.gov/|PMID\s*:?\s*)(\d+)"
PMCID_SHAPE = r"(PMC\d+)"
#: Request headers that are no part of a cache key, as they hold secrets, and response
#: headers that are kept with a cached body.
SECRET_HEADERS = ("authorization", "x-api-key", "cookie")
KEPT_HEADERS = ("content-type", "etag", "last-modified")


#: White space that is stripped from the ends of values.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(c, F.lit(WHITE))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain(c: Column | str) -> Column:
    """Text without braces and outer white space; '' for null."""
    return strip(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"[{}]", ""))


def _unwrapped(c: Column | str) -> Column:
    """Plain text without a leading ``doi:`` label and resolver address."""
    text = F.regexp_replace(plain(c), r"(?i)^doi\s*:\s*", "")
    return F.regexp_replace(text, r"(?i)^https?://(dx\.)?doi\.org/", "")


def doi(c: Column | str) -> Column:
    """Bare lower-case DOI; text without a DOI-shaped part is kept as it is, in lower case."""
    text = _unwrapped(c)
    shaped = F.regexp_extract(text, f"({DOI_SHAPE})", 1)
    return F.lower(F.rtrim(F.when(shaped != "", shaped).otherwise(text), F.lit(".,; ")))


def pmid(c: Column | str) -> Column:
    """First run of digits."""
    return F.regexp_extract(F.regexp_replace(plain(c), r"(?i)^pmid\s*:\s*", ""), r"(\d+)", 1)


def pmcid(c: Column | str) -> Column:
    """Upper-case ``PMC`` and digits."""
    return F.regexp_extract(F.upper(plain(c)), PMCID_SHAPE, 1)


def arxiv(c: Column | str) -> Column:
    """arXiv id of either style, without version, in lower case."""
    return F.lower(F.regexp_extract(F.replace(plain(c), F.lit(".pdf"), F.lit("")), ARXIV_SHAPE, 1))


def _first(*cs: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))


def extract(fields: dict[str, Column]) -> Column:
    """struct(doi, pmid, pmcid, arxiv) of an entry; missing fields count as empty.

    Named fields come first, then url, note and howpublished are searched.
    """
    get = lambda k: plain(fields[k]) if k in fields else F.lit("")
    hay = F.concat_ws(" ", get("url"), get("note"), get("howpublished"))
    d = _first(F.when(get("doi") != "", doi(get("doi"))).otherwise(""), F.lower(F.rtrim(F.regexp_extract(hay, f"({DOI_SHAPE})", 1), F.lit(".,; "))))
    p = _first(pmid(get("pmid")), F.regexp_extract(hay, PMID_IN_TEXT, 1))
    c = _first(pmcid(get("pmcid")), pmcid(hay))
    a = _first(arxiv(get("eprint")), arxiv(hay), arxiv(F.regexp_extract(d, r"^10\.48550/arxiv\.(.+)$", 1)))
    return F.struct(d.alias("doi"), p.alias("pmid"), c.alias("pmcid"), a.alias("arxiv"))


def with_ids(df: DataFrame, fields: dict[str, Column], prefix: str, own: bool = False) -> DataFrame:
    """``df`` with the columns of :func:`extract` as ``<prefix>doi``, ``<prefix>pmid``,
    ``<prefix>pmcid`` and ``<prefix>arxiv``.

    In steps, so that no expression is repeated wherever its result is used. With ``own`` the forms
    of the named fields alone are kept as ``<prefix>doi_``, ``pmid_``, ``pmcid_`` and ``eprint_``.
    """
    named = {"doi": doi, "pmid": pmid, "pmcid": pmcid, "eprint": arxiv}
    get = lambda k: fields.get(k, F.lit(""))
    step = df.withColumns({f"{prefix}{k}_": f(get(k)) for k, f in named.items()} | {f"{prefix}hay": F.concat_ws(" ", *[plain(get(k)) for k in ("url", "note", "howpublished")])})
    hay, own = F.col(f"{prefix}hay"), lambda k: F.col(f"{prefix}{k}_")
    found = {"doi": F.lower(F.rtrim(F.regexp_extract(hay, f"({DOI_SHAPE})", 1), F.lit(".,; "))), "pmid": F.regexp_extract(hay, PMID_IN_TEXT, 1), "pmcid": pmcid(hay)}
    step = step.withColumns({f"{prefix}{k}": F.when(own(k) != "", own(k)).otherwise(v) for k, v in found.items()} | {f"{prefix}arxiv_": F.when(own("eprint") != "", own("eprint")).otherwise(arxiv(hay))})
    by_doi = arxiv(F.regexp_extract(f"{prefix}doi", r"^10\.48550/arxiv\.(.+)$", 1))
    step = step.withColumn(f"{prefix}arxiv", F.when(F.col(f"{prefix}arxiv_") != "", F.col(f"{prefix}arxiv_")).otherwise(by_doi))
    return step.drop(*[f"{prefix}{k}_" for k in (*(() if own else named), "arxiv")], f"{prefix}hay")


def has_any(ids: Column) -> Column:
    return (ids["doi"] != "") | (ids["pmid"] != "") | (ids["pmcid"] != "") | (ids["arxiv"] != "")


def display_doi(c: Column | str) -> Column:
    """DOI without wrapper, in its own letter case, outer ``.,;`` and blanks trimmed."""
    return F.trim(F.btrim(F.trim(_unwrapped(c)), F.lit(".,; ")))


def url_host(c: Column | str) -> Column:
    """Lower-case host of a URL, its scheme being optional; '' if there is none."""
    u = F.trim(F.coalesce(_col(c), F.lit("")))
    full = F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("http://"), u))
    return F.rtrim(F.lower(F.coalesce(F.try_parse_url(full, F.lit("HOST")), F.lit(""))), F.lit("."))


def is_arxiv_url(c: Column | str) -> Column:
    host = url_host(c)
    return (host == "arxiv.org") | host.endswith(".arxiv.org")


def has_arxiv(fields: dict[str, Column]) -> Column:
    """Whether an entry names arXiv: by prefix, URL, new-style eprint or DOI."""
    get = lambda k: plain(fields[k]) if k in fields else F.lit("")
    return (
        (F.lower(get("archiveprefix")) == "arxiv")
        | is_arxiv_url(get("url"))
        | get("eprint").rlike(r"^\d{4}\.\d{4,5}(v\d+)?$")
        | F.lower(doi(get("doi"))).startswith("10.48550/arxiv.")
    )


def as_map(ids: Column) -> Column:
    """The identifiers that are present, as a map of name -> value."""
    names = ("doi", "pmid", "pmcid", "arxiv")
    return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), ids[n])]), lambda k, v: v != "")


def citation_key(family: Column, year: Column, title: Column, doi_col: Column) -> Column:
    """Family name, year and first ASCII word of the title, those that are known; if none is, the
    last part of the DOI. Runs of other signs become one underscore; outer ``_:-`` are dropped."""
    word = F.regexp_extract(F.coalesce(title, F.lit("")), r"([A-Za-z0-9]+)", 1)
    known = F.concat(F.coalesce(family, F.lit("")), F.coalesce(year, F.lit("")), word)
    raw = F.when(known != "", known).otherwise(F.substring_index(doi(doi_col), "/", -1))
    clean = F.btrim(F.regexp_replace(raw, r"[^A-Za-z0-9_:-]+", "_"), F.lit("_:-"))
    return F.when(clean == "", F.lit("crossref_entry")).otherwise(clean)


def json_text(c: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes, control and other characters are escaped."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    table = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    units = lambda ch: F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), r"(.{4})", r"\\u$1")
    one = lambda ch: F.coalesce(table[ch], F.when(ch.rlike(r"^[\x20-\x7e]$"), ch).otherwise(units(ch)))
    body = F.when(c.rlike(r'[^\x20-\x7e]|["\\]'), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _json_object(entries: Column) -> Column:
    parts = F.transform(F.array_sort(entries), lambda e: F.concat(json_text(e["key"]), F.lit(":"), json_text(F.coalesce(e["value"], F.lit("")))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def cache_key(url: Column, params: Column, headers: Column | None = None) -> Column:
    """SHA-256 of a request as compact JSON with sorted names: url, parameters and those headers
    that hold no secret, their names in lower case (``params`` and ``headers`` are string maps)."""
    named = F.filter(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))), lambda e: ~e["key"].isin(*SECRET_HEADERS)) if headers is not None else F.map_entries(F.create_map().cast("map<string,string>"))
    text = F.concat(F.lit('{"headers":'), _json_object(named), F.lit(',"params":'), _json_object(F.map_entries(params)), F.lit(',"url":'), json_text(url), F.lit("}"))
    return F.sha2(text, 256)


def kept_headers(headers: Column) -> Column:
    """The response headers that are stored with a cached body."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(*KEPT_HEADERS))
