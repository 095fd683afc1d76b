"""Queries of the llm operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refaudit.session import read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from refaudit.llm import matching

    return matching.found(read(spark, d, "cases"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from refaudit.llm import survivors

    return survivors.of_record(spark, d).select("doi", "field_name", "rec_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from refaudit.llm import charforms

    return charforms.found(read(spark, d, "cases"), read(spark, d, "search_openalex"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from refaudit.llm import mojibake

    return mojibake.found(read(spark, d, "cases"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from refaudit.llm import names

    return names.found(read(spark, d, "cases"), read(spark, d, "search_europepmc"), read(spark, d, "match_s2"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from refaudit.llm import tokens

    return tokens.encode(read(spark, d, "documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    from refaudit.llm import packing, tokens

    return packing.pack(tokens.count_tokens(read(spark, d, "documents")), read(spark, d, "containers"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from refaudit.llm import languages

    return languages.found(read(spark, d, "documents"), read(spark, d, "languages"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_pack": p7_pack, "p8_found": p8_found}


def _value_of_record() -> str:
    """The definition of the values of record in SQL; ties of trust and time don't occur in it."""
    from refaudit.llm import survivors
    from refaudit.plans import sql

    key = f"nullif(lower(rtrim(regexp_extract({sql.plain('doi')}, '{sql.DOI_SHAPE}', 1, 'i'), '.,;:)] ')), '')"
    fillers = ", ".join(f"'{f}'" for f in survivors.FILLERS)
    full = f"value IS NOT NULL AND lower(trim(value)) NOT IN ({fillers})"
    return (
        f"WITH oa AS (SELECT {key} AS k, rec_id, feed, updated_at AS upd, biblio FROM search_openalex), cr AS (SELECT {key} AS k, rec_id, feed, updated_at AS upd, container_title FROM search_crossref), "
        f"cc AS (SELECT * FROM (SELECT k, rec_id, feed, upd, unnest(list_distinct(container_title)) AS value FROM cr WHERE k IS NOT NULL) WHERE {full}), "
        "tally AS (SELECT value, count(*) AS n FROM cc GROUP BY 1), "
        "cut AS (SELECT value FROM tally WHERE regexp_matches(value, '\\p{L}\\.(\\s|$)') UNION SELECT t.value FROM tally t JOIN tally l ON length(l.value) > length(t.value) AND starts_with(l.value, t.value) AND l.n >= t.n WHERE NOT regexp_matches(l.value, '\\.(\\s|$)')), "
        "claims AS (SELECT k, 'container_title' AS field_name, value, rec_id, feed, upd FROM cc WHERE value NOT IN (SELECT value FROM cut) AND k IN (SELECT k FROM cr GROUP BY 1 HAVING count(*) > 1) "
        f"UNION ALL SELECT k, f, value, rec_id, feed, upd FROM (SELECT k, rec_id, feed, upd, f, CASE f WHEN 'volume' THEN biblio.volume ELSE biblio.first_page END AS value FROM oa, (VALUES ('volume'), ('first_page')) t(f) WHERE k IN (SELECT k FROM oa WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) WHERE {full}), "
        "best AS (SELECT c.k, c.field_name, c.value, row_number() OVER (PARTITION BY c.k, c.field_name ORDER BY coalesce(f.trust, 0) DESC, c.upd DESC NULLS LAST, c.value) AS rn FROM claims c LEFT JOIN feeds f ON f.feed = c.feed) "
        "SELECT b.k AS doi, b.field_name, min(c.rec_id) AS rec_id FROM best b JOIN claims c ON c.k = b.k AND c.field_name = b.field_name AND c.value = b.value WHERE b.rn = 1 GROUP BY 1, 2"
    )


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _value_of_record()}
