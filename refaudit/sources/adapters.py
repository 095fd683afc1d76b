"""Projections of source payloads to one entry schema, one declarative mapping per source.

An adapter takes a struct column (a parsed payload) or the columns of a table and gives a dict of
field name -> Column; a blank or missing value gives null. Nothing is collected and no UDF is
needed apart from HTML escapes in titles and venues.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.functions import text

Entry = dict[str, Column]
#: The fields of an entry, in the order they are written.
ENTRY_FIELDS = ("title", "author", "editor", "journal", "booktitle", "volume", "number", "pages", "year", "month", "publisher", "organization", "institution", "address", "edition", "chapter", "series", "note", "doi", "url", "eprint", "archiveprefix", "primaryclass", "pmid", "howpublished", "school")
#: Entry types by the type names of the sources.
TYPES = {
    "crossref": {"journal-article": "article", "book-chapter": "incollection", "book": "book", "proceedings-article": "inproceedings", "posted-content": "unpublished"},
    "openalex": {"journal-article": "article", "book-chapter": "incollection", "book": "book", "proceedings-article": "inproceedings", "article": "article"},
    "dblp": {"Conference and Workshop Papers": "inproceedings", "Journal Articles": "article", "Informal Publications": "article", "Parts in Books or Collections": "incollection"},
}
#: Payload schemas for ``from_json``.
DDL = {
    "dblp": "type STRING, title STRING, authors STRUCT<author: STRING>, year STRING, venue STRING, volume STRING, pages STRING, doi STRING, ee STRING",
    "pubmed": "uid STRING, title STRING, authors ARRAY<STRUCT<name: STRING>>, pubdate STRING, fulljournalname STRING, source STRING, volume STRING, issue STRING, pages STRING, elocationid STRING, articleids ARRAY<STRUCT<idtype: STRING, value: STRING>>",
    "core": "title STRING, authors ARRAY<STRUCT<name: STRING>>, yearPublished INT, publishedDate STRING, journals ARRAY<STRING>, doi STRING, downloadUrl STRING",
    "biorxiv": "doi STRING, title STRING, authors STRING, date STRING, version STRING, category STRING, journal STRING, biorxiv_url STRING, preprint_url STRING",
    "crossref": "type STRING, title ARRAY<STRING>, author ARRAY<STRUCT<given: STRING, family: STRING>>, published STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, `published-print` STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, `container-title` ARRAY<STRING>, volume STRING, issue STRING, page STRING, publisher STRING, DOI STRING",
    "openalex": "id STRING, type STRING, title STRING, publication_year INT, doi STRING, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, primary_location STRUCT<source: STRUCT<display_name: STRING>>, biblio STRUCT<volume: STRING, issue: STRING, first_page: STRING, last_page: STRING>, host_organization STRUCT<display_name: STRING>",
    "semantic_scholar": "paperId STRING, matchScore DOUBLE, title STRING, authors ARRAY<STRUCT<name: STRING>>, year INT, venue STRING, publicationTypes ARRAY<STRING>, journal STRUCT<name: STRING>, doi STRING, externalIds STRUCT<DOI: STRING, ArXiv: STRING, PubMed: STRING>",
    "europe_pmc": "id STRING, source STRING, title STRING, authorString STRING, pubYear STRING, journalTitle STRING, journalVolume STRING, issue STRING, pageInfo STRING, doi STRING, pmid STRING, pmcid STRING",
    "arxiv": "id STRING, published STRING, title STRING, author ARRAY<STRUCT<name: STRING>>, primary_category STRUCT<_term: STRING>, journal_ref STRING, doi STRING",
}


def _type(source: str, c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPES[source].items() for x in kv])[c], F.lit("article"))


def _dashes(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit("--"))


def _names(array: Column) -> Column:
    """Non-blank names joined; null if none is left."""
    kept = F.filter(array, lambda n: F.coalesce(n, F.lit("")) != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, " and "))


def _four_digits(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{4})", 1)


def _finish(e: Entry) -> Entry:
    return {k: text.present(v) for k, v in e.items()}


def crossref(r: Callable[[str], Column], native: bool = False) -> Entry:
    """First title; ``Family, Given`` authors; the first date part; venue by type."""
    kind = _type("crossref", r("type"))
    with_family = F.filter(r("author"), lambda a: a["family"].isNotNull())
    author = F.transform(with_family, lambda a: F.when(a["given"].isNotNull(), F.concat_ws(", ", a["family"], a["given"])).otherwise(a["family"]))
    part = lambda c: F.get(F.get(c["date-parts"], F.lit(0)), F.lit(0))
    container = F.get(r("container_title"), F.lit(0))
    return _finish({
        "ENTRYTYPE": kind, "title": text.field_value(F.get(r("title"), F.lit(0)), native=native), "author": _names(author),
        "journal": F.when(kind == "article", text.field_value(container, native=native)), "booktitle": F.when(kind == "inproceedings", text.field_value(container, protect=False, native=native)),
        "year": F.when(r("published").isNotNull(), part(r("published"))).otherwise(part(r("published_print"))).cast("string"),
        "volume": r("volume"), "number": r("issue"), "pages": _dashes(r("page")), "publisher": r("publisher"), "doi": r("doi"),
    })


def openalex(r: Callable[[str], Column], native: bool = False) -> Entry:
    """Display names; venue by type; first and last page joined."""
    kind = _type("openalex", r("type"))
    venue = text.field_value(r("primary_location")["source"]["display_name"], native=native)
    b = r("biblio")
    first, last = text.present(b["first_page"]), text.present(b["last_page"])
    return _finish({
        "ENTRYTYPE": kind, "title": text.field_value(r("title"), native=native), "author": _names(F.transform(r("authorships"), lambda a: a["author"]["display_name"])),
        "journal": F.when(kind == "article", venue), "booktitle": F.when(kind == "inproceedings", venue), "year": r("publication_year").cast("string"),
        "volume": b["volume"], "number": b["issue"], "pages": F.when(first.isNotNull() & last.isNotNull(), F.concat(b["first_page"], F.lit("--"), b["last_page"])).otherwise(b["first_page"]),
        "doi": F.replace(r("doi"), F.lit("https://doi.org/"), F.lit("")), "publisher": r("host_organization")["display_name"],
    })


def semantic_scholar(r: Callable[[str], Column], native: bool = False) -> Entry:
    """Type from the publication types; the journal's name goes before the venue."""
    kinds = F.coalesce(r("publicationtypes"), F.array().cast("array<string>"))
    kind = F.when(F.array_contains(kinds, "JournalArticle"), "article").when(F.array_contains(kinds, "Conference"), "inproceedings").otherwise("article")
    venue = text.field_value(r("venue"), native=native)
    ext = r("externalids")
    arx = ext["ArXiv"]
    return _finish({
        "ENTRYTYPE": kind, "title": text.field_value(r("title"), native=native), "author": _names(r("authors")["name"]), "year": r("year").cast("string"),
        "journal": F.coalesce(text.present(text.field_value(r("journal")["name"], native=native)), F.when(kind == "article", venue)), "booktitle": F.when(kind == "inproceedings", venue),
        "doi": F.coalesce(text.present(r("doi")), ext["DOI"]), "eprint": arx, "archiveprefix": F.when(arx.isNotNull(), "arXiv"), "pmid": ext["PubMed"],
    })


def europe_pmc(r: Callable[[str], Column], native: bool = False) -> Entry:
    """Always an article; the author string is split at comma and blank."""
    authors = F.split(r("authorstring"), ", ")
    return _finish({
        "ENTRYTYPE": F.lit("article"), "title": text.field_value(r("title"), native=native), "author": F.when(r("authorstring") != "", F.array_join(authors, " and ")), "year": r("pubyear"),
        "journal": text.field_value(r("journaltitle"), native=native), "volume": r("journalvolume"), "number": r("issue"), "pages": _dashes(r("pageinfo")), "doi": r("doi"), "pmid": r("pmid"), "pmcid": r("pmcid"),
    })


def dblp(r: Callable[[str], Column], native: bool = False) -> Entry:
    """The author may be one object or a list of them; both forms are read from its JSON."""
    kind = _type("dblp", r("type"))
    raw = r("authors")["author"]
    many = F.from_json(F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), "array<struct<text: string>>")
    venue = text.field_value(r("venue"), native=native)
    return _finish({
        "ENTRYTYPE": kind, "title": text.field_value(r("title"), native=native), "author": _names(many["text"]), "year": r("year"), "journal": F.when(kind == "article", venue),
        "booktitle": F.when(kind == "inproceedings", venue), "volume": r("volume"), "pages": _dashes(r("pages")), "doi": r("doi"), "url": r("ee"),
    })


def pubmed(r: Callable[[str], Column], native: bool = False) -> Entry:
    """Always an article; identifiers from the article id list, the last of a kind counting."""
    last = lambda *kinds: F.element_at(F.filter(r("articleids"), lambda a: a["idtype"].isin(*kinds))["value"], -1)
    of = lambda *kinds: F.when(F.size(F.filter(r("articleids"), lambda a: a["idtype"].isin(*kinds))) > 0, last(*kinds))
    eloc = F.regexp_extract(F.coalesce(r("elocationid"), F.lit("")), r"doi:\s*(.+)", 1)
    return _finish({
        "ENTRYTYPE": F.lit("article"), "title": text.field_value(r("title"), native=native), "author": _names(r("authors")["name"]), "year": _four_digits(r("pubdate")),
        "journal": text.field_value(F.coalesce(text.present(r("fulljournalname")), r("source")), native=native), "volume": r("volume"), "number": r("issue"), "pages": _dashes(r("pages")),
        "doi": F.coalesce(of("doi"), eloc), "pmid": of("pubmed"), "pmcid": of("pmc", "pmcid"),
    })


def core(r: Callable[[str], Column], native: bool = False) -> Entry:
    return _finish({
        "ENTRYTYPE": F.lit("article"), "title": text.field_value(r("title"), native=native), "author": _names(r("authors")["name"]),
        "year": F.coalesce(r("yearPublished").cast("string"), _four_digits(r("publishedDate"))), "journal": text.field_value(F.get(r("journals"), F.lit(0)), native=native), "doi": r("doi"), "url": r("downloadUrl"),
    })


def arxiv(r: Callable[[str], Column], native: bool = False) -> Entry:
    """One feed entry; the id keeps its version and no DOI is made up."""
    journal = F.coalesce(text.present(r("journal_ref")), F.lit("arXiv"))
    return _finish({
        "ENTRYTYPE": F.lit("article"), "title": text.field_value(F.replace(F.trim(r("title")), F.lit("\n"), F.lit(" ")), native=native), "author": _names(F.transform(r("author")["name"], lambda n: F.trim(n))),
        "year": F.substring(F.trim(r("published")), 1, 4), "eprint": F.element_at(F.split(F.trim(r("id")), "/"), -1), "archiveprefix": F.when(r("id").isNotNull(), "arXiv"),
        "primaryclass": r("primary_category")["_term"], "journal": text.field_value(journal, native=native), "doi": r("doi"),
    })


def biorxiv(r: Callable[[str], Column], native: bool = False) -> Entry:
    """Authors at semicolons, or a list of names or of objects with a name; the preprint address goes
    before the server's own."""
    raw = F.trim(r("authors"))  # a list is kept as its JSON text
    objects = F.from_json(raw, "array<struct<name: string>>")["name"]
    listed = F.when(raw.rlike(r"^\[\s*\{"), objects).otherwise(F.from_json(raw, "array<string>"))
    names = F.when(raw.startswith("["), listed).otherwise(F.transform(F.split(raw, ";"), lambda n: F.trim(n)))
    return _finish({
        "ENTRYTYPE": F.lit("article"), "title": text.field_value(r("title"), native=native), "author": _names(names), "year": _four_digits(r("date")),
        "journal": text.field_value(F.coalesce(text.present(r("journal")), F.lit("bioRxiv")), native=native), "doi": r("doi"), "url": F.coalesce(text.present(r("preprint_url")), r("biorxiv_url")),
        "note": F.when(text.present(r("version")).isNotNull(), F.concat(F.lit("Version "), r("version"))), "keywords": r("category"),
    })


ADAPTERS: dict[str, Callable[..., Entry]] = {"crossref": crossref, "openalex": openalex, "semantic_scholar": semantic_scholar, "europe_pmc": europe_pmc, "dblp": dblp, "pubmed": pubmed, "core": core, "arxiv": arxiv, "biorxiv": biorxiv}
#: Columns of the tables that go by another name than in the adapters, and the same for payloads.
RENAMED = {"crossref": {"type": "work_type"}, "openalex": {"type": "work_type"}, "semantic_scholar": {"year": "pub_year"}}
RENAMED_JSON = {"crossref": {"container_title": "container-title", "published_print": "published-print"}}
#: Identifier kinds that a source is asked by, in order; whether an unknown identifier
#: leads on to a title search; how many records an identifier yields at most.
ACCESS = {
    "crossref": (["doi"], True, 1), "openalex": (["doi"], False, 5), "semantic_scholar": (["doi", "arxiv", "pmid"], True, 1), "pubmed": (["pmid", "pmcid", "doi"], False, 5),
    "europe_pmc": (["pmid", "pmcid", "doi"], False, 5), "arxiv": (["arxiv"], False, 1), "biorxiv": (["doi"], False, 5), "dblp": ([], True, 5), "core": ([], True, 5),
}


def register(name: str, adapter: Callable[..., Entry], kinds: list[str] = [], falls_back: bool = True, limit: int = 5, ddl: str | None = None) -> None:  # noqa: B006
    """Add a source: its adapter, the identifier kinds it is asked by, whether an unknown identifier
    leads on to a title search, its limit, and the schema of its payloads if it has any."""
    ADAPTERS[name], ACCESS[name] = adapter, (list(kinds), falls_back, limit)
    if ddl:
        DDL[name] = ddl


def adapt(df: DataFrame, source: str, keys: list[str], native: bool = False) -> DataFrame:
    """(keys, entry fields) of a table of one source's records."""
    names = RENAMED.get(source, {})
    entry = ADAPTERS[source](lambda c: F.col(names.get(c, c)), native)
    return df.select(*keys, *[v.alias(k) for k, v in entry.items()])


def of_struct(df: DataFrame, source: str, keys: list[str], struct: str, native: bool = False) -> DataFrame:
    """(keys, entry fields) of a parsed payload; a null one gives nulls."""
    names = RENAMED_JSON.get(source, {})
    entry = ADAPTERS[source](lambda c: F.col(struct)[names.get(c, c)], native)
    return df.select(*keys, *[v.alias(k) for k, v in entry.items()])


def adapt_json(df: DataFrame, source: str, keys: list[str], payload: str = "payload", native: bool = False) -> DataFrame:
    """As :func:`adapt`, for raw JSON payloads; a payload that is no object gives nulls."""
    return of_struct(df.select(*keys, F.from_json(payload, DDL[source]).alias("_p")), source, keys, "_p", native)


def adapt_atom(df: DataFrame, keys: list[str], payload: str = "payload", native: bool = False) -> DataFrame:
    """arXiv entries of raw Atom XML, one ``<entry>`` element a row."""
    plain = F.regexp_replace(F.col(payload), r"<(/?)\w+:", "<$1")
    return of_struct(df.select(*keys, F.from_xml(plain, DDL["arxiv"]).alias("_p")), "arxiv", keys, "_p", native)


def records_of(df: DataFrame, source: str, keys: list[str], native: bool = False) -> DataFrame:
    """(keys, entry fields) of a table of records, or of raw payloads if it has that column."""
    if "payload" not in df.columns:
        return adapt(df, source, keys, native)
    return adapt_atom(df, keys, native=native) if source == "arxiv" else adapt_json(df, source, keys, native=native)
