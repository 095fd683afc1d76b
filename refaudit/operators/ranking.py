"""Order of the sources for each entry, and selection among scored candidates.

All windows lead with the entry id, so one shuffle serves ranking, selection, early stop and the
outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refaudit.functions import identifiers as ids
from refaudit.operators.scoring import MARGIN

#: The sources with their default order and whether they are on.
SOURCES = [("crossref", 1, True), ("openalex", 2, True), ("semantic_scholar", 3, True), ("pubmed", 4, True), ("europe_pmc", 5, True), ("core", 6, False), ("unpaywall", 7, False), ("dblp", 8, True), ("arxiv", 9, True), ("biorxiv", 10, True), ("base", 11, False), ("google_scholar", 99, False)]
#: Parts of venue, publisher, keywords or title that hint at a field of research.
BIOMEDICAL = ["pubmed", "pmc", "medline", "medicine", "medical", "biomed", "biology", "bioinformatics", "genome", "clinical", "epidemiology", "biorxiv", "medrxiv"]
COMPUTING = ["acm", "ieee", "computer", "computing", "software", "algorithm", "machine learning", "artificial intelligence", "neural", "conference on", "symposium on"]
#: Query statuses of a source that could not be asked.
UNAVAILABLE = ["rate_limited", "auth_error", "network_error", "provider_error", "parse_error"]


def sources(spark: SparkSession, rows: list[tuple[str, int, bool]] = SOURCES) -> DataFrame:
    """(source, base_pos) of the sources that are on, in ascending priority, ties in given order."""
    on = sorted(((p, i, n) for i, (n, p, ok) in enumerate(rows) if ok))
    return spark.createDataFrame([(n, i) for i, (_, _, n) in enumerate(on)], "source string, base_pos int")


def _hay(fields: dict[str, Column]) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(fields[k], F.lit("")) for k in ("journal", "booktitle", "publisher", "keywords", "title") if k in fields]))


def _known(fields: dict[str, Column], name: str) -> Column:
    return F.coalesce(fields[name], F.lit("")) != "" if name in fields else F.lit(False)


def biomedical(fields: dict[str, Column]) -> Column:
    hay = _hay(fields)
    return _known(fields, "pmid") | _known(fields, "pmcid") | hay.rlike("|".join(BIOMEDICAL))


def computing(fields: dict[str, Column]) -> Column:
    return _hay(fields).rlike("|".join(COMPUTING))


def rank_sources(entries: DataFrame, fields: dict[str, Column], id_col: str, table: DataFrame) -> DataFrame:
    """(id, source, rank): for each entry the sources, those that fit its identifiers and field
    of research first. ``table`` is the small fixed table of sources."""
    marked = entries.select(id_col, _known(fields, "doi").alias("_doi"), biomedical(fields).alias("_bio"), ids.has_arxiv(fields).alias("_arx"), computing(fields).alias("_cs"))
    s = F.col("source")
    boost = (
        F.when(F.col("_doi") & (s == "crossref"), -100).when(F.col("_arx") & (s == "arxiv"), -90).when(F.col("_bio") & (s == "pubmed"), -80)
        .when(F.col("_bio") & (s == "europe_pmc"), -70).when(F.col("_cs") & (s == "dblp"), -60).when(F.col("_bio") & (s == "biorxiv"), -30).otherwise(0)
    )
    # twelve rows at most: an array literal of the sources, exploded, needs no join at all
    rows = table.collect()
    each = F.explode(F.array(*[F.struct(F.lit(r["source"]).alias("source"), F.lit(r["base_pos"]).alias("base_pos")) for r in rows]))
    wide = marked.select("*", each.alias("_s")).select("*", "_s.*").withColumn("boost", boost)
    w = Window.partitionBy(id_col).orderBy("boost", "base_pos")
    return wide.select(id_col, "source", F.row_number().over(w).alias("rank"))


def select(candidates: DataFrame, keys: list[str], margin: float = MARGIN) -> DataFrame:
    """Per (entry, source) its status and best candidate, from rows with status, score, cand_pos.

    Any conflict makes the source a conflict; two candidates within ``margin`` make it ambiguous;
    rows that match nothing are not viable.
    """
    w = Window.partitionBy(*keys)
    viable = F.col("status").isin("matched", "ambiguous")
    conflict = F.max((F.col("status") == "identifier_conflict").cast("int")).over(w) == 1
    kept = candidates.withColumn("_c", conflict).withColumn("_v", F.when(F.col("_c"), F.col("status") == "identifier_conflict").otherwise(viable))
    order = w.orderBy(F.col("_v").desc(), F.when(F.col("_c"), F.lit(0.0)).otherwise(F.col("score")).desc(), "cand_pos")
    ranked = kept.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead(F.when(F.col("_v"), F.col("score"))).over(order))
    first = ranked.where("_n = 1")
    status = (
        F.when(F.col("_c"), "identifier_conflict").when(~F.col("_v"), "no_match")
        .when(F.col("_next").isNotNull() & (F.col("score") - F.col("_next") <= margin), "ambiguous").otherwise(F.col("status"))
    )
    keep = [c for c in candidates.columns if c not in (*keys, "status", "score", "cand_pos")]
    best = lambda c: F.when(F.col("_v"), F.col(c)).alias(c)
    return first.select(*keys, status.alias("source_status"), best("score"), best("cand_pos"), *[best(c) for c in keep])


def consulted(results: DataFrame, id_col: str, stop_on_match: bool = True) -> DataFrame:
    """The source rows that a walk in rank order reaches: it ends after a conflict, and after a
    match if ``stop_on_match``."""
    ends = F.col("source_status") == "identifier_conflict"
    if stop_on_match:
        ends |= F.col("source_status") == "matched"
    before = Window.partitionBy(id_col).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return results.withColumn("_over", F.coalesce(F.bool_or(ends).over(before), F.lit(False))).where("not _over").drop("_over")


def outcomes(results: DataFrame, id_col: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per entry: status, best source and score, completeness, the sources in order, and
    the columns ``carried`` of the best source."""
    s = F.col("source_status")
    any_ = lambda c: F.bool_or(c)
    best = lambda k: F.min_by(F.struct("source", "score", *carried), F.when(s == k, F.struct(-F.coalesce(F.col("score"), F.lit(0.0)), F.col("rank"))))
    g = results.groupBy(id_col).agg(
        any_(s == "identifier_conflict").alias("c"), any_(s == "matched").alias("m"), any_(s == "ambiguous").alias("a"), any_(s.isin(UNAVAILABLE)).alias("u"), any_(s == "no_match").alias("n"),
        best("identifier_conflict").alias("bc"), best("matched").alias("bm"), best("ambiguous").alias("ba"),
        F.sort_array(F.collect_list(F.struct("rank", "source", F.col("source_status").alias("status")))).alias("providers"),
    )
    status = F.when(F.col("c"), "identifier_conflict").when(F.col("m"), "verified").when(F.col("a"), "ambiguous").when(F.col("u"), "source_unavailable").when(F.col("n"), "not_found").otherwise("invalid_input")
    chosen = F.when(F.col("c"), F.col("bc")).when(F.col("m"), F.col("bm")).when(F.col("a"), F.col("ba"))
    complete = F.when(F.col("c") | F.col("m") | F.col("a"), ~F.col("u")).when(F.col("u"), False).otherwise(F.col("n"))
    return g.select(id_col, status.alias("status"), chosen["source"].alias("source"), chosen["score"].alias("score"), complete.alias("complete"), "providers", *[chosen[c].alias(c) for c in carried])


def first_match(results: DataFrame, id_col: str) -> DataFrame:
    """(id, source, candidate): the best candidate of the first source, in rank order, that has one,
    whatever its status."""
    got = results.where(F.col("cand_pos").isNotNull())
    best = got.groupBy(id_col).agg(F.min_by(F.struct("source", "candidate"), "rank").alias("_b"))
    return best.select(id_col, "_b.*")


def status_of_http(code: Column) -> Column:
    """Query status of an HTTP response code."""
    return F.when(code.between(200, 299), "ok").when(code == 404, "no_match").when(code == 429, "rate_limited").when(code.isin(401, 403), "auth_error").otherwise("provider_error")


def exit_code(c: dict[str, Column], complete: Column) -> Column:
    """Process exit code of a run from its bucket counts."""
    return (
        F.when(c["invalid_input"] > 0, 5).when(~complete | (c["source_unavailable"] > 0) | (c["errors"] > 0), 4)
        .when((c["ambiguous"] > 0) | (c["not_found"] > 0) | (c["identifier_conflict"] > 0), 3).when(c["updated"] > 0, 2).otherwise(0)
    )
