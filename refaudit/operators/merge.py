"""Field-by-field merge of an entry with its candidate; nothing is ever removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.functions import identifiers as ids
from refaudit.functions import text

#: Fields that are never, or only at high confidence, replaced.
IDENTIFIER_FIELDS = ("doi", "pmid", "pmcid", "eprint")
CONSERVATIVE_FIELDS = ("title", "author", "editor", "journal", "booktitle", "year", "volume", "number", "pages", "publisher", "ENTRYTYPE")
THRESHOLD = 0.92


def decisions(df: DataFrame, keys: list[str], original: dict[str, Column], suggested: dict[str, Column], confidence: Column, threshold: float = THRESHOLD, norm=text.normalize) -> DataFrame:
    """(keys, field, original, suggested, normalized_equal, action), a row per suggested field.

    Blank suggestions give no row; fields that only the original has stay untouched.
    """
    value = lambda c: ids.strip(F.coalesce(c.cast("string"), F.lit("")))
    row = [F.struct(F.lit(f).alias("field"), value(original.get(f, F.lit(""))).alias("original"), value(v).alias("suggested")) for f, v in suggested.items() if f != "ID"]
    each = df.select(*keys, confidence.alias("_conf"), F.explode(F.array(*row)).alias("x")).select(*keys, "_conf", "x.*").where("suggested <> ''")
    # one comparison a row, whatever the number of fields
    long = each.withColumn("normalized_equal", text.any_field_form(F.col("field"), F.col("original"), norm) == text.any_field_form(F.col("field"), F.col("suggested"), norm))
    sure = F.col("_conf") >= threshold
    action = (
        F.when(F.col("normalized_equal") & (F.col("original") != ""), "keep_original")
        .when(F.col("original") == "", F.when(sure, "add").otherwise("suggest"))
        .when(F.lower("field").isin(*IDENTIFIER_FIELDS), "manual_review")
        .when(F.col("field").isin(*CONSERVATIVE_FIELDS) & sure, "update")
        .otherwise("suggest")
    )
    return long.select(*keys, "field", "original", "suggested", "normalized_equal", action.alias("action"))


def applied(action: Column) -> Column:
    return action.isin("add", "update")


def meaningful(action: Column, equal: Column) -> Column:
    return ~equal & (action != "keep_original")


def merged(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, changes, differences, field_diffs, n_applied, n_meaningful) of the decisions.

    ``changes`` maps a field to its applied value, ``differences`` to the whole applied change;
    ``field_diffs`` lists every decision by field name.
    """
    a = applied(F.col("action"))
    change = F.struct("original", "suggested", "action")
    every = F.struct("field", "original", "suggested", "normalized_equal", "action")
    each = F.sort_array(F.collect_list(F.when(a, F.struct("field", change.alias("change")))))
    return long.groupBy(*keys).agg(
        F.map_from_entries(F.transform(each, lambda e: F.struct(e["field"], e["change"]["suggested"]))).alias("changes"), F.map_from_entries(each).alias("differences"),
        F.sort_array(F.collect_list(every)).alias("field_diffs"), F.count_if(a).alias("n_applied"), F.count_if(meaningful(F.col("action"), F.col("normalized_equal"))).alias("n_meaningful"),
    )


def long_form(entries: DataFrame, keys: list[str], fields: tuple[str, ...] | list[str]) -> DataFrame:
    """(keys, field, value) of a wide table; missing values are left out."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return entries.select(*keys, F.explode(rows).alias("_x")).select(*keys, "_x.*").where("value is not null")


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of two long tables (keys, field, value) whose values differ apart from braces and
    case; a field that one side lacks counts as empty there."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"[{}]", ""))
    a = left.where("field <> 'ID'").select(*keys, "field", ids.strip(F.coalesce("value", F.lit(""))).alias("original"))
    b = right.where("field <> 'ID'").select(*keys, "field", ids.strip(F.coalesce("value", F.lit(""))).alias("updated"))
    j = a.join(b, [*keys, "field"], "full_outer").fillna("", ["original", "updated"])
    return j.where(plain(F.col("original")) != plain(F.col("updated"))).select(*keys, "field", "original", "updated")
