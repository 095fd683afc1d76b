"""Lookup of entries in source tables: exact identifiers first, titles where that fails."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from refaudit.functions import identifiers as ids
from refaudit.operators import overlap
from refaudit.session import materialize, release

#: Records of a block and entries of a part that meet in one task, and pairs from which there are more tasks.
BLOCK, PART, PAIRS = 250_000, 150_000, 200_000_000
LIMIT = 5


def id_index(records: DataFrame, id_col: str, kinds: dict[str, Column], limit: int | None = None) -> DataFrame:
    """(kind, value, id) of every identifier a record carries; blanks are left out.

    With ``limit`` an identifier keeps its first records by id, as a source answers it with no
    more: a hot identifier is cut down before it meets the entries (partly before the shuffle).
    """
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])
    each = records.select(F.col(id_col), F.explode(rows).alias("i")).select("i.kind", "i.value", id_col).where("value is not null and value <> ''")
    if limit is None:
        return each.distinct()
    first = Window.partitionBy("kind", "value").orderBy(id_col)
    return each.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")


def first_id(kinds: list[str], values: dict[str, Column]) -> Column:
    """struct(kind, value) of the first identifier present, in the source's order; null if none."""
    return F.coalesce(*[F.when(values[k] != "", F.struct(F.lit(k).alias("kind"), values[k].alias("value"))) for k in kinds])


def exact(entries: DataFrame, index: DataFrame, entry_id: str, chosen: Column) -> DataFrame:
    """(entry, record id, kind) by the chosen identifier: an equi-join on kind and value."""
    asked = entries.select(entry_id, chosen.alias("_k")).where("_k is not null").select(entry_id, "_k.kind", "_k.value")
    return asked.join(index, ["kind", "value"]).drop("value")


def by_title(entries: DataFrame, records: DataFrame, entry_id: str, record_id: str, left: Column, right: Column, limit: int = LIMIT, least: Column | None = None) -> DataFrame:
    """(entry, record id, shared, rank): the ``limit`` records closest to each entry's title by
    the share of common words, ties by id; a record without a common word is none of them.

    This is exact, whatever words the titles have. Titles of the same words rank alike and are
    looked up once. Every part of the entries meets every block of the records in one task, which
    counts the common words (:mod:`overlap`) and returns a few records an entry; no pair is written.
    Ids are taken to be unique.

    With ``least``, a number of the entry, those of the ``limit`` records are left out whose titles have
    a lesser share of common words and can hold, or be part of, the entry's at no place either.
    """
    words = lambda c: F.array_join(F.sort_array(F.array_distinct(F.array_remove(F.split(c, " "), ""))), " ")
    of_entry = entries.select(F.col(entry_id), words(left).alias("_w"), (F.lit(0.0) if least is None else least).cast("double").alias("_least")).where("_w <> ''")
    e = materialize(of_entry.groupBy("_w").agg(F.min(entry_id).alias("_e"), F.min("_least").alias("_least")))
    first = Window.partitionBy("_rw").orderBy(record_id)
    r = records.select(F.col(record_id), words(right).alias("_rw")).where("_rw <> ''").withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= limit)
    r = materialize(r.groupBy("_rw").agg(F.min(record_id).alias("_r"), F.collect_list(record_id).alias("_ids")))
    release(e.sparkSession)
    blocks, parts = spread(e.count(), r.count(), e.sparkSession.sparkContext.defaultParallelism)

    crossed = lambda d, w, own, n, other, m: d.withColumns({own: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    asked = crossed(e, "_w", "_part", parts, "_block", blocks).groupBy("_block", "_part")
    held = crossed(r.select("_rw", "_r"), "_rw", "_block", blocks, "_part", parts).groupBy("_block", "_part")
    out = StructType.fromDDL(f"_e {e.schema['_e'].dataType.simpleString()}, _r {r.schema['_r'].dataType.simpleString()}, shared int, _share double, _reach double")
    types = {f.name: f.type for f in to_arrow_schema(out)}

    def top(a: pa.Table, h: pa.Table) -> pa.Table:
        if not a.num_rows or not h.num_rows:
            return pa.table({c: pa.array([], t) for c, t in types.items()})
        one = lambda t, c: pa.concat_arrays(t.column(c).chunks)
        w, rw = one(a, "_w"), one(h, "_rw")
        i, j, shared = overlap.closest(w, rw, one(h, "_r"), limit)
        size = lambda x, at: pc.add(pc.count_substring(x.take(pa.array(at)), " "), 1).to_numpy(zero_copy_only=False)
        a_size, h_size = size(w, i), size(rw, j)
        share = shared / (a_size + h_size - shared)
        # of a title that is part of another one all words but the first and the last are words of that
        reach = np.where(shared >= np.minimum(a_size, h_size) - 2, 1.0, share)
        if blocks == 1:  # what comes after the last record that is kept; among the blocks' records it would count
            floor = np.full(a.num_rows, np.inf)
            kept = reach >= one(a, "_least").to_numpy()[i]
            np.minimum.at(floor, i[kept], share[kept])
            kept = share >= floor[i]
            i, j, shared, share, reach = (x[kept] for x in (i, j, shared, share, reach))
        made = {"_e": one(a, "_e").take(pa.array(i)), "_r": one(h, "_r").take(pa.array(j)), "shared": pa.array(shared), "_share": pa.array(share), "_reach": pa.array(reach)}
        return pa.table({c: made[c].cast(t) for c, t in types.items()})

    closest = asked.cogroup(held).applyInArrow(top, out)
    few = Window.partitionBy("_e").orderBy(F.col("_share").desc(), "_r")
    if blocks > 1:  # of records with the same words only those of the first sets can be in the result
        closest = closest.withColumn("_i", F.row_number().over(few)).where(F.col("_i") <= limit)
    best = closest.join(r.select("_r", "_ids"), "_r").select("_e", "shared", "_share", "_reach", F.explode("_ids").alias(record_id))
    w = Window.partitionBy("_e").orderBy(F.col("_share").desc(), record_id)
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return of_entry.join(e.select("_w", "_e"), "_w").select(entry_id, "_e", "_least").join(ranked, "_e").where("_reach >= _least").select(entry_id, record_id, "shared", "rank")


def spread(entries: int, records: int, cores: int) -> tuple[int, int]:
    """(blocks of the records, parts of the entries): as many tasks as the pairs are worth, one a core
    at most where memory allows, as every part has all records written and counted once more."""
    blocks = max(1, -(-records // BLOCK))
    tasks = min(cores, -(-entries * records // PAIRS))
    return blocks, max(1, -(-entries // PART), -(-tasks // blocks))


def with_fallback(hits: DataFrame, entries: DataFrame, search, entry_id: str) -> DataFrame:
    """Exact hits, and for entries without any the result of ``search(rest of the entries)``."""
    rest = entries.join(hits.select(entry_id).distinct(), entry_id, "left_anti")
    return hits.unionByName(search(rest))


def two_hop(hits: DataFrame, records: DataFrame, entry_id: str, record_id: str, via: Column, limit: int = LIMIT) -> DataFrame:
    """(entry, via, record id): a search that yields values of ``via`` (the ids of a source), then
    the first records that carry them. Hits without such a value lead nowhere."""
    named = records.select(F.col(record_id), via.alias("via")).where("via is not null and via <> ''")
    found = hits.select(entry_id, record_id).join(named, record_id).select(entry_id, "via").distinct()
    first = Window.partitionBy("via").orderBy(record_id)
    held = named.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")
    return found.join(held, "via").select(entry_id, "via", record_id)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the given order (an upsert log reduced to its state)."""
    body = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*body), F.struct(*order)).alias("_b"))
    return best.select(key, "_b.*")


def cached(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: float) -> DataFrame:
    """Requests with ``hit`` and the cached body; an entry older than the ttl is a miss."""
    fresh = unexpired(cache, now, ttl_seconds)
    return requests.join(fresh, "cache_key", "left").withColumn("hit", F.col("created").isNotNull())


def cacheable(status: Column, body_bytes: Column, limit: int = 10 * 1024 * 1024) -> Column:
    return status.between(200, 299) & (body_bytes <= limit)


def unexpired(cache: DataFrame, now: Column, ttl_seconds: float) -> DataFrame:
    """The rows of a cache that are still valid; what is older is removed by writing these back."""
    return cache.where((F.lit(ttl_seconds) > 0) & (now - F.col("created") <= ttl_seconds))


def put(cache: DataFrame, responses: DataFrame) -> DataFrame:
    """The cache (cache_key, created, status, headers, body) after storing ``responses``: those of
    success and bounded size with their harmless headers, the latest of a key."""
    kept = responses.where(cacheable(F.col("status"), F.octet_length("body"))).withColumn("headers", ids.kept_headers(F.col("headers")))
    return latest(cache.unionByName(kept.select(*cache.columns)), "cache_key", ["created"])
