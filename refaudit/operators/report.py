"""Counts, metrics and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The result buckets in the order they are reported.
BUCKETS = ("verified", "updated", "ambiguous", "not_found", "source_unavailable", "identifier_conflict", "invalid_input", "errors")
REVIEW = BUCKETS[2:]
CSV_COLUMNS = ("key", "status", "complete", "confidence", "reason", "platform")


def duplicate_keys(entries: DataFrame, key: str, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, key, n) of the keys that occur more than once, within one list if it is named."""
    return entries.where(F.col(key).isNotNull()).groupBy(*scope, key).agg(F.count("*").alias("n")).where("n > 1")


def valid_keys(entries: DataFrame, key: str, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Entries whose key is present and unique (counted, then joined: no window on a hot key)."""
    bad = duplicate_keys(entries, key, scope).select(*scope, key)
    return entries.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").join(bad, [*scope, key], "left_anti")


def bucket_counts(results: DataFrame, bucket: str = "bucket") -> DataFrame:
    """One row: the count of each bucket and the total."""
    return results.agg(*[F.count_if(F.col(bucket) == b).alias(b) for b in BUCKETS], F.count("*").alias("total"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def metrics(pairs: DataFrame, positive: str = "matched") -> DataFrame:
    """Accuracy, precision, recall and rate of wrong automatic matches, rounded to 4 digits."""
    p, e = F.col("predicted") == positive, F.col("expected") == positive
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return pairs.agg(
        F.count("*").alias("cases"), share(F.count_if(F.col("predicted") == F.col("expected")), F.count("*")).alias("accuracy"), share(F.count_if(p & e), F.count_if(p)).alias("match_precision"),
        share(F.count_if(p & e), F.count_if(e)).alias("match_recall"), share(F.count_if(p & ~e), F.count("*")).alias("wrong_auto_match_rate"),
    )


def ordered(results: DataFrame, pos: str, bucket: str = "bucket") -> DataFrame:
    """Results with ``bucket_ord``, sorted bucket by bucket in the fixed order and by input order
    within; a range-partitioned sort, so that a large bucket spreads over many tasks."""
    place = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col(bucket))
    return results.withColumn("bucket_ord", place.cast("int")).orderBy("bucket_ord", pos)


#: Labels of the text report.
LABELS = {
    "EN": {"title": "Report on the reference list", "complete": "Complete", "yes": "yes", "no": "no", "counts": "Counts", "entries": "Entries that need a look"},
    "CN": {"title": "参考文献核查报告", "complete": "核查完整", "yes": "是", "no": "否", "counts": "数量", "entries": "需要查看的条目"},
}
#: Columns of a result that the reports leave out: they hold whole records.
BULKY = ("changes", "pos", "path", "bucket", "n_applied", "n_meaningful")


def summary(results: DataFrame) -> DataFrame:
    """One row: counts of the buckets, and whether every entry was fully looked up.

    A run with errors or invalid input is never complete.
    """
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    whole = F.coalesce(F.bool_and(F.coalesce("complete", F.lit(False))), F.lit(True)) & (F.count_if(F.col("bucket").isin("errors", "invalid_input")) == 0)
    return results.agg(F.lit("1.0").alias("schema_version"), whole.alias("complete"), F.struct(F.count("*").alias("total"), *counts).alias("counts"))


def _entries(results: DataFrame) -> tuple[DataFrame, list[str]]:
    at = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket")) if "bucket" in results.columns else F.lit(1)
    place = F.struct(F.coalesce(at, F.lit(0)).cast("int").alias("bucket"), F.col("path") if "path" in results.columns else F.lit("").alias("path"), F.col("pos").cast("bigint").alias("pos"))
    return results.withColumn("_at", place), [c for c in results.columns if c not in BULKY]


def _lines(head: DataFrame, body: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    parts = [head.select(F.lit(0).alias("part"), F.lit(None).cast("struct<bucket: int, path: string, pos: bigint>").alias("at"), "value"), body.select(F.lit(1).alias("part"), F.col("_at").alias("at"), "value")]
    if tail is not None:
        parts.append(tail.select(F.lit(2).alias("part"), F.lit(None).cast("struct<bucket: int, path: string, pos: bigint>").alias("at"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def jsonl(results: DataFrame, about: dict[str, str] | None = None) -> DataFrame:
    """(part, at, value): a report of JSON lines, the summary first, then an entry a line."""
    rows, shown = _entries(results)
    extra = [F.lit(v).alias(k) for k, v in (about or {}).items()]
    head = summary(results).select(F.to_json(F.struct(F.lit("summary").alias("type"), "*", *extra)).alias("value"))
    return _lines(head, rows.select("_at", F.to_json(F.struct(F.lit("entry").alias("type"), *shown)).alias("value")))


def document(results: DataFrame, about: dict[str, str] | None = None) -> DataFrame:
    """(part, at, value): lines that in their order are one JSON document, the counts and an array of
    the entries. No line holds more than one entry, whatever the size of the run."""
    rows, shown = _entries(results)
    extra = [F.lit(v).alias(k) for k, v in (about or {}).items()]
    head = summary(results).select(F.concat(F.regexp_replace(F.to_json(F.struct("*", *extra)), r"\}$", ""), F.lit(', "entries": [')).alias("value"))
    tail = summary(results).select(F.lit("]}").alias("value"))
    first = rows.agg(F.min("_at").alias("_at")).withColumn("_first", F.lit(True))
    comma = F.when(F.col("_first"), "").otherwise(", ")
    body = rows.select("_at", F.struct(*shown).alias("_e")).join(first, "_at", "left").select("_at", F.concat(comma, F.to_json("_e")).alias("value"))
    return _lines(head, body, tail)


def text_report(results: DataFrame, language: str = "EN") -> DataFrame:
    """(part, at, value): title, completeness and counts, then every entry that is not verified with
    its confidence, reason and the changes that were not kept out."""
    t = LABELS[language]
    rows, _ = _entries(results)
    s = summary(results)
    rule = "=" * 72
    counts = [F.concat(F.lit(f"  {b}: "), F.col(f"counts.{b}").cast("string")) for b in ("total", *BUCKETS)]
    head = s.select(F.array_join(F.array(F.lit(rule), F.lit(t["title"]), F.concat(F.lit(f"{t['complete']}: "), F.when(F.col("complete"), t["yes"]).otherwise(t["no"])), F.lit(rule), F.lit(f"{t['counts']}:"), *counts, F.lit(""), F.lit(f"{t['entries']}:")), "\n").alias("value"))
    lines = [F.concat(F.lit("- "), F.coalesce("key", F.lit("")), F.lit(": "), F.coalesce("status", F.lit("unknown"))), F.concat(F.lit("  confidence: "), F.coalesce(F.col("confidence").cast("string"), F.lit("-"))), F.concat(F.lit("  reason: "), F.coalesce("reason", F.lit("")))]
    value = F.array_join(F.array(*lines), "\n")
    if "field_diffs" in results.columns:
        open_ = F.filter("field_diffs", lambda d: d["action"] != "keep_original")
        value = F.concat_ws("\n", value, F.array_join(F.transform(open_, lambda d: F.concat(F.lit("  "), d["field"], F.lit(": "), d["action"], F.lit(" ("), F.coalesce("platform", F.lit("-")), F.lit(", "), F.coalesce(F.col("confidence").cast("string"), F.lit("-")), F.lit(")"))), "\n"))
        value = F.rtrim(value, F.lit("\n"))
    return _lines(head, rows.where("status is null or status <> 'verified'").select("_at", value.alias("value")))


def csv_lines(results: DataFrame) -> DataFrame:
    """(part, at, value): a header and six columns an entry; quotes where a value needs them."""
    rows, _ = _entries(results)
    quoted = lambda c: F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    shown = {"complete": F.when(F.col("complete"), "True").otherwise("False")}
    body = rows.select("_at", F.concat_ws(",", *[quoted(shown.get(c, F.col(c).cast("string"))) for c in CSV_COLUMNS]).alias("value"))
    return _lines(results.sparkSession.range(1).select(F.lit(",".join(CSV_COLUMNS)).alias("value")), body)


def review(results: DataFrame) -> DataFrame:
    """The entries of the buckets that need a look, with their order."""
    return ordered(results.where(F.col("bucket").isin(*REVIEW)), "pos")


def merge_maps(base: Column, over: Column) -> Column:
    """One map over another; the second wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)


def lines(results: DataFrame, form: str, language: str = "EN", about: dict[str, str] | None = None) -> DataFrame:
    """The lines of a report in one of its four forms, as (part, at, value)."""
    if form == "csv":
        return csv_lines(results)
    if form == "json":
        return document(results, about)
    if form == "jsonl":
        return jsonl(results, about)
    if form == "txt":
        return text_report(results, language)
    raise ValueError(f"unknown report form: {form}")


def write(results: DataFrame, path: str, form: str, language: str = "EN") -> None:
    """A report as files in a folder, through Spark's commit protocol; in the order of their names
    they are one report."""
    lines(results, form, language).orderBy("part", "at").select("value").write.mode("overwrite").text(path)
