"""Filling of fixed-capacity containers by minimum bin slack over a histogram of sizes.

Only the histogram of sizes (at most ``capacity`` rows, whatever the corpus holds) reaches the
driver. There every bin starts with the largest size left; a bitset subset-sum over the sizes left
finds the fullest combination that fits beside it. The combination is used as often as the
counts allow and removed, so the number of plans is bounded by the number of distinct sizes. The
items are then numbered within their size on the cluster, a hot size being split into salted
sub-groups, and each item looks its bin up in the plan.

Defined results: an item larger than the capacity is cut into full bins and a rest; no other item
is cut; an item without tokens takes no room and comes out once with a null bin; items with null
size count as having no tokens; repeated ids are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refaudit.session import materialize

#: Sub-groups that the items of one size are numbered in.
SALTS = 64


def fullest(sizes: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of sizes, none used more often than counted, with the largest sum <= room."""
    steps: list[tuple[int, int, int]] = []
    reach, mask, full = 1, (1 << (room + 1)) - 1, 1 << room
    for s in sizes:
        left = min(counts[s], room // s)
        part = 1
        while left > 0 and not reach & full:
            take = min(part, left)
            steps.append((s, take, reach))
            reach |= (reach << (s * take)) & mask
            left -= take
            part *= 2
        if reach & full:
            break
    total, chosen = reach.bit_length() - 1, {}
    for s, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[s] = chosen.get(s, 0) + take
            total -= s * take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """((size, first rank, uses in a bin, first bin) of each block, number of bins)."""
    counts = {s: c for s, c in histogram.items() if c > 0}
    sizes = sorted(counts, reverse=True)
    done: dict[int, int] = dict.fromkeys(counts, 0)
    blocks, bins = [], 0
    while sizes:
        top = sizes[0]
        counts[top] -= 1
        chosen = fullest([s for s in sizes if s <= capacity - top and counts[s] > 0], counts, capacity - top)
        counts[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        times = min(counts[s] // k for s, k in chosen.items())
        for s, k in chosen.items():
            blocks.append((s, done[s], k, bins))
            done[s] += k * times
            counts[s] -= k * times
        bins += times
        sizes = [s for s in sizes if counts[s] > 0]
    return blocks, bins


def pack(items: DataFrame, containers: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(container, bin_id, id, piece, start, n_tokens): a place for every token of every item.

    ``containers`` has (container, capacity), a few rows; rows with null or non-positive capacity
    are left out of it. Bins are numbered from 0 in each container.
    """
    kind = items.schema[id_col].dataType.simpleString()
    boxes = {r[0]: int(r[1]) for r in containers.select("container", "capacity").where("capacity > 0").collect()}
    schema = f"container string, bin_id bigint, {id_col} {kind}, piece bigint, start bigint, n_tokens bigint"
    spark = items.sparkSession
    if not boxes:
        return spark.createDataFrame([], schema)
    base = materialize(items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)).alias("n")))
    # the containers ride along as an array literal: no join
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(k).cast("bigint").alias("cap")) for c, k in sorted(boxes.items())]))
    cut = base.where("n > 0").select("id", "n", each.alias("b")).select(
        "id", "n", "b.container", "b.cap", F.expr("n div b.cap").alias("whole"), (F.col("n") % F.col("b.cap")).alias("rest"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    )
    tally = materialize(cut.groupBy("container", "cap", "rest", "salt").agg(F.count("*").alias("items"), F.sum("whole").alias("wholes")))
    histogram = tally.where("rest > 0").groupBy("container", "rest").agg(F.sum("items").alias("k")).collect()
    plans = {}
    for c, cap in boxes.items():
        blocks, bins = plan({int(r["rest"]): int(r["k"]) for r in histogram if r["container"] == c}, cap)
        blocks.sort()
        key = np.array([s << 40 | first for s, first, _, _ in blocks], np.int64)
        plans[c] = (key, np.array([b[1:] for b in blocks], np.int64).reshape(-1, 3), bins)
    # first rank of each sub-group within its size, and first bin of each sub-group of whole pieces
    before = Window.partitionBy("container", "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    wholes = tally.groupBy("container", "salt").agg(F.sum("wholes").alias("w"))
    over = Window.partitionBy("container").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    whole_at = {(r["container"], r["salt"]): int(r["at"]) for r in wholes.select("container", "salt", F.coalesce(F.sum("w").over(over), F.lit(0)).alias("at")).collect()}
    starts = tally.select("container", "rest", "salt", F.coalesce(F.sum("items").over(before), F.lit(0)).alias("at"))
    within = Window.partitionBy("container", "rest", "salt").orderBy("id")
    ranked = (
        cut.where("rest > 0").withColumn("r", F.row_number().over(within) - 1).join(starts, ["container", "rest", "salt"])
        .select("container", "id", "whole", "cap", "rest", (F.col("r") + F.col("at")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_numpy(zero_copy_only=False)
            whole, cap, rest, rank = (b.column(i).to_numpy() for i in range(2, 6))
            out = np.zeros(len(names), np.int64)
            for c in set(names.tolist()):
                at = np.flatnonzero(names == c)
                key, body, _ = plans[c]
                first, uses, bin0 = body[np.searchsorted(key, rest[at].astype(np.int64) << 40 | rank[at], "right") - 1].T
                out[at] = bin0 + (rank[at] - first) // uses
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), b.column(1), pa.array(whole), pa.array(whole * cap), pa.array(rest)], ["container", "bin_id", id_col, "piece", "start", "n_tokens"])

    rests = ranked.mapInArrow(place, schema)
    first_whole = F.create_map(*[x for (c, s), at in whole_at.items() for x in (F.lit(f"{c}\0{s}"), F.lit(at + plans[c][2]))]) if whole_at else F.create_map(F.lit(""), F.lit(0))
    run = Window.partitionBy("container", "salt").orderBy("id", "n").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        cut.where("whole > 0")
        .withColumn("at", F.coalesce(F.sum("whole").over(run), F.lit(0)) + first_whole[F.concat_ws("\0", "container", F.col("salt").cast("string"))])
        .select("container", "id", "cap", "at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"))
        .select("container", (F.col("at") + F.col("piece")).alias("bin_id"), F.col("id").alias(id_col), "piece", (F.col("piece") * F.col("cap")).alias("start"), F.col("cap").alias("n_tokens"))
    )
    none = base.where("n <= 0").select("id", each.alias("b")).select("b.container", F.lit(None).cast("bigint").alias("bin_id"), F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n_tokens"))
    return rests.unionByName(pieces).unionByName(none)
