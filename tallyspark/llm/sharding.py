"""Minimax contiguous partition of ordered atomic groups into shards.

The driver searches over a bounded number of bins of consecutive groups. Bins that
a cut may fall into are opened into finer bins, until the cuts are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import shuffle_partitions, text_of, written

#: Most bins that the driver holds at a time.
MAX_BINS = 1 << 16
#: Parts of a group's rows, so that no task numbers a third of all rows.
SALTS = 256


def greedy(starts: np.ndarray, total: int, first: int, shards: int, capacity: int) -> np.ndarray | None:
    """Starts of the shards when each takes all it can; None when they don't hold everything.

    starts: where groups begin, in order, in units of size. A shard takes groups as
    long as their end is at most capacity from the shard's start.
    """
    edges = np.append(starts, total)
    cuts = [first]
    while len(cuts) <= shards:
        if cuts[-1] + capacity >= total:
            return np.array(cuts)
        end = edges[np.searchsorted(edges, cuts[-1] + capacity, "right") - 1]
        if end <= cuts[-1]:
            return None
        cuts.append(int(end))
    return None


def smallest_capacity(starts: np.ndarray, total: int, first: int, shards: int) -> int:
    """Binary search of the smallest capacity for which greedy cutting needs no more than the shards."""
    low, high = max(1, -(-(total - first) // shards)), max(1, total - first)
    while low < high:
        middle = (low + high) // 2
        if greedy(starts, total, first, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


@dataclass
class Plan:
    """giants: keys of groups larger than an equal share, each in a shard of its own, shard 0 first.
    cuts: start offsets of the other shards among the other groups. capacity: of those shards."""

    giants: list
    cuts: list[int]
    capacity: int


def _ordered(groups: DataFrame, giants: list) -> DataFrame:
    """The other groups in the order of their smallest row, with their start offset.

    Range partitions, their totals, and a running sum within each: no single task
    sees all groups.
    """
    spark = groups.sparkSession
    rest = groups.where(~F.col("key").isin(giants)) if giants else groups
    ranged = written(
        rest.repartitionByRange(shuffle_partitions(spark), "first_row", "key").withColumn("part", F.spark_partition_id()),
        "ordered-groups",
    )
    running = Window.partitionBy("part").orderBy("first_row", "key").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("bytes").alias("part_bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("part_start"))
    return written(
        ranged.join(F.broadcast(offsets), "part").select(
            "key", "bytes", (F.col("part_start") + F.coalesce(F.sum("bytes").over(running), F.lit(0))).alias("start")
        ),
        "group-starts",
    )


def plan(groups: DataFrame, shards: int) -> tuple[Plan, DataFrame]:
    """groups: key, bytes, first_row. Gives the plan and the other groups with their starts.

    A group larger than an equal share of what is left stands first in the order, in
    a shard of its own; there are fewer of them than shards.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    giants, left = [], total
    for row in groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect():
        if row.bytes * (shards - len(giants)) <= left:
            break
        giants.append(row.key)
        left -= row.bytes
    others, open_shards = _ordered(groups, giants), shards - len(giants)
    width = max(1, -(-left // MAX_BINS))
    bins = _bins(others, width)
    opened = lambda b: np.ones(len(b), bool)  # noqa: E731  no cut falls outside what was opened last
    while True:
        starts = bins["start"].to_numpy(np.int64)
        capacity = smallest_capacity(starts, left, 0, open_shards)
        cuts = greedy(starts, left, 0, open_shards, capacity)
        widest = int(np.max(np.where((bins["groups"] > 1) & opened(bins), bins["bytes"], 0), initial=0))
        if not widest:
            break
        # cuts at bins' edges need at most one bin more than cuts between groups
        least = max(1, capacity - 2 * widest)
        windows = _windows(bins, *_bounds(bins, left, open_shards, least, capacity))
        if not windows:
            break
        width = min(max(1, width // 2), max(1, sum(e - s for s, e in windows) // (MAX_BINS // 2)))
        inside = " OR ".join(f"(start >= {s} AND start < {e})" for s, e in windows)  # one a shard at most; the scan gets it
        opened = lambda b, w=windows: np.any([(b["start"] >= s) & (b["start"] < e) for s, e in w], axis=0)
        bins = _merged(bins[~opened(bins)], _bins(others.where(inside), width))
    return Plan(giants, [int(c) for c in cuts], int(capacity)), others


def _bins(groups: DataFrame, width: int):
    """At most about MAX_BINS rows: consecutive groups whose starts share a cell of the width."""
    return (
        groups.groupBy(F.expr(f"start div {width}").alias("cell"))
        .agg(F.min("start").alias("start"), F.sum("bytes").alias("bytes"), F.count("*").alias("groups"))
        .select("start", "bytes", "groups").toPandas().sort_values("start", ignore_index=True)
    )


def _merged(a, b):
    import pandas as pd

    return pd.concat([a, b]).sort_values("start", ignore_index=True)


def _windows(bins, early: list[int], late: list[int]) -> list[tuple[int, int]]:
    """The stretches, from bin to bin, that a cut may fall into and that hold a bin of several groups."""
    starts = bins["start"].to_numpy(np.int64)
    ends, several = starts + bins["bytes"].to_numpy(np.int64), bins["groups"].to_numpy() > 1
    out: list[tuple[int, int]] = []
    for low, high in zip(early, late, strict=True):
        at = np.flatnonzero(several & (ends > low) & (starts <= high))
        if not len(at):
            continue
        s, e = int(starts[at[0]]), int(ends[at[-1]])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _bounds(bins, total: int, shards: int, least: int, capacity: int) -> tuple[list[int], list[int]]:
    """Where the k-th cut can fall, whatever lies inside the bins: capacities from least to capacity."""
    early, late, low, high = [], [], 0, 0
    edges, single = np.append(bins["start"].to_numpy(np.int64), total), bins["groups"].to_numpy() == 1
    for _ in range(shards - 1):
        low = edges[max(0, np.searchsorted(edges, low + least, "right") - 1)]
        high = min(total, high + capacity)
        at = max(0, np.searchsorted(edges, high, "right") - 1)
        if high < total and single[at]:  # it can't be cut
            high = edges[at]
        early.append(int(low))
        late.append(int(high))
    return early, late


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    size: UTF-8 bytes of the text plus the overhead. Rows with equal texts are an
    atomic group; null counts as empty there. Groups are ordered by their smallest
    doc_id and cut so that the largest shard is as small as can be. slot numbers a
    shard's rows from 0 without gaps. An empty table gives no rows. Repeated rows
    and null identifiers are rows like others.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text_of(text_col), 256)).alias("key"),
        (F.octet_length(text_of(text_col)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text_of(text_col)).alias("text_crc32"),
    ).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    rows = written(rows, "shard-rows")
    parts = rows.groupBy("key", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("id").alias("first_row"))
    parts = written(parts, "shard-parts")
    groups = parts.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.min("first_row").alias("first_row"))
    found, others = plan(groups, shards)
    ahead = len(found.giants)
    cuts = F.array(*[F.lit(c) for c in found.cuts])
    shard = others.select("key", (ahead - 1 + F.size(F.filter(cuts, lambda c: c <= F.col("start")))).alias("shard"))
    if found.giants:
        own = spark.createDataFrame([(k, i) for i, k in enumerate(found.giants)], "key binary, shard int")
        shard = shard.unionByName(own)
    placed = written(parts.join(shard, "key").select("key", "salt", "rows", "shard"), "shard-placed")

    # slots: a part's first slot is what lies before it in its shard, summed over ranges of parts
    cell = F.pmod(F.xxhash64("key", "salt"), F.lit(1024)).alias("cell")
    cells = placed.groupBy("shard", cell).agg(F.sum("rows").alias("cell_rows"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("cell_rows").over(before("shard", ["cell"])), F.lit(0)).alias("cell_slot"))
    offsets = (
        placed.withColumn("cell", cell).join(F.broadcast(cells), ["shard", "cell"])  # at most 1024 rows a shard
        .select(
            "key", "salt", "shard",
            (F.col("cell_slot") + F.coalesce(F.sum("rows").over(before("shard", "cell", ["key", "salt"])), F.lit(0))).alias("part_slot"),
        )
    )
    in_part = F.row_number().over(Window.partitionBy("key", "salt").orderBy("id")) - 1
    return rows.withColumn("in_part", in_part).join(offsets, ["key", "salt"]).select(
        F.col("id").alias(id_col), "size", "text_crc32",
        F.col("shard").cast("int").alias("shard"), (F.col("part_slot") + F.col("in_part")).cast("long").alias("slot"),
    )


def query(docs: DataFrame) -> DataFrame:
    return shard_documents(docs.select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
