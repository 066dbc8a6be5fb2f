"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the row's id). Splitters between shards are found by
counting: each round sends a bounded list of probe keys to all partitions, which count the bytes and
rows below each probe exactly; the probes then close in on each wanted boundary. When all
splitters are within tolerance, or no key lies between two probes, every row is exchanged once.
Equal texts are neighbours in this order, and a splitter falls between texts, unless a group of copies
holds more than GROUP_SHARE of a shard's bytes: such a group is cut by the second part of the key.

A shard's rows are numbered in parts of about a million, cut by further splitters with a wide tolerance;
where each part starts is a small table that is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.llm.common import broadcast_rows, stored

PROBES = 32  # for each splitter and round
TOLERANCE = 0.001  # of a shard's bytes
GROUP_SHARE = 0.01  # of a shard's bytes: smaller groups of copies are never cut
SUB_ROWS = 1_000_000  # rows numbered in one task
MOST_PARTS = 200_000  # whose first slots are broadcast
SUB_PROBES, SUB_TOLERANCE = 4, 0.25  # for the parts in which rows are numbered

_LOW = -(1 << 63)


def _below(batches, probes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bytes and rows of this partition between each probe and the next."""
    bytes_, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for batch in batches:
        slot = _slots(np.asarray(batch.column(0)), np.asarray(batch.column(1)), probes)
        bytes_ += np.bincount(slot, np.asarray(batch.column(2)), len(bytes_)).astype(np.int64)
        rows += np.bincount(slot, minlength=len(rows))
    some = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bytes_[some]), pa.array(rows[some])], names=["slot", "bytes", "rows"])


def _slots(a: np.ndarray, b: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Of each key (a, b) the number of probes <= it; probes are sorted pairs."""
    first = probes["a"]
    slot = np.searchsorted(first, a, side="left")
    tie = np.flatnonzero((slot < len(first)) & (first[np.minimum(slot, len(first) - 1)] == a)) if len(first) else []
    if len(tie):  # probes with the same first part: order by the second
        end = np.searchsorted(first, a[tie], side="right")
        start = slot[tie]  # a copy: a row may get the slot where the next probes with one first part start
        for s, e in set(zip(start.tolist(), end.tolist(), strict=True)):
            own = tie[start == s]
            slot[own] = s + np.searchsorted(probes["b"][s:e], b[own], side="right")
    return slot


KEY = np.dtype([("a", np.int64), ("b", np.int64)])


def _between(low: tuple[int, int], high: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to n keys after low and up to high, evenly spaced; by the first part while it differs by more than one."""
    if high[0] - low[0] > 1:
        step = (high[0] - low[0]) / (n + 1)
        return sorted({(low[0] + int(step * (i + 1)), _LOW) for i in range(n)} - {low})
    if high[0] > low[0] and high[1] == _LOW:
        high = (low[0], (1 << 63) - 1)
    if high[0] > low[0]:
        return [(high[0], _LOW)]
    step = (high[1] - low[1]) / (n + 1)
    return sorted({(low[0], low[1] + int(step * (i + 1))) for i in range(n)} - {low})


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE, group_share: float = GROUP_SHARE, probes: int = PROBES) -> list[tuple[int, int]]:
    """shards - 1 keys; shard i has the keys from splitter i - 1 on, below splitter i. keyed: a, b, size.

    The driver keeps two keys for each splitter and gets one row for each probe; its work is linear in the shards.
    """
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = [total * i // shards for i in range(1, shards)]
    slack, share = tolerance * total / shards, group_share * total / shards
    top = ((1 << 63) - 1, (1 << 63) - 1)
    # of each wanted boundary: the last key known to have at most so many bytes below it, the first known to have more, their bytes and rows
    low = [((_LOW, _LOW), 0, 0)] * len(wanted)
    high = [(top, total, -1)] * len(wanted)

    def searching(i: int) -> bool:
        (a, below, first), (b, above, last) = low[i], high[i]
        if min(wanted[i] - below, above - wanted[i]) <= slack or first == last - 1 or a == b:
            return False
        return not (a[1] == b[1] == _LOW and b[0] == a[0] + 1 and above - below <= share)  # a group too small to be cut

    while True:
        open_ = [i for i in range(len(wanted)) if searching(i)]
        known = {x[0] for i in open_ for x in (low[i], high[i])}
        ask = sorted({p for i in open_ for p in _between(low[i][0], high[i][0], probes)} - known)
        if not ask:
            break
        keys = np.array(ask, KEY)
        counted = keyed.select("a", "b", "size").mapInArrow(lambda it: _below(it, keys), "slot long, bytes long, rows long")  # noqa: B023
        bytes_, rows = np.zeros(len(ask) + 1, np.int64), np.zeros(len(ask) + 1, np.int64)
        for r in counted.groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect():  # at most a row for each probe
            bytes_[r.slot], rows[r.slot] = r.bytes, r.rows
        bytes_, rows = np.cumsum(bytes_)[:-1], np.cumsum(rows)[:-1]  # below each probe
        after = np.searchsorted(bytes_, [wanted[i] for i in open_], side="right")
        for i, k in zip(open_, after.tolist(), strict=True):
            if k and ask[k - 1] > low[i][0]:
                low[i] = (ask[k - 1], int(bytes_[k - 1]), int(rows[k - 1]))
            if k < len(ask) and ask[k] < high[i][0]:
                high[i] = (ask[k], int(bytes_[k]), int(rows[k]))
    return [lo[0] if w - lo[1] <= hi[1] - w else hi[0] for w, lo, hi in zip(wanted, low, high, strict=True)]


def shard(docs: DataFrame, order: list[Column], size: Column, shards: int, tolerance: float = TOLERANCE, group_share: float = GROUP_SHARE, sub_rows: int = SUB_ROWS) -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (0, 1, ... within a shard, in key order), exchanged once.

    order: two long columns, the sort key; rows equal in the first are a group (equal texts), rows equal in both
    stay together and are ordered by all columns. size: the bytes of a row, not null. Shards differ from the mean by
    `tolerance` of it at each end, or by half a row or a group of at most `group_share` where one lies there; larger groups
    are cut. Null and empty texts are rows like any other (their size says what they weigh), a very long one
    counts whole. Fewer rows than shards leave shards empty; empty tables stay
    empty. Columns named shard or slot are replaced.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    keyed = docs.select(*names, order[0].alias("__wl_a"), order[1].alias("__wl_b"), size.cast("long").alias("__wl_size"))
    narrow = stored(keyed.select(F.col("__wl_a").alias("a"), F.col("__wl_b").alias("b"), F.col("__wl_size").alias("size")), "keys")
    cuts = splitters(narrow, shards, tolerance, group_share)
    parts = -(-narrow.count() // sub_rows)
    within = splitters(narrow, parts, SUB_TOLERANCE, 0.0, SUB_PROBES) if parts > 1 else []
    bounds = np.array(sorted([*cuts, *within]), KEY)  # equal neighbours only make parts without rows
    owner = np.searchsorted(np.array(cuts, KEY), bounds, side="right") if cuts else np.zeros(len(bounds), np.int64)
    owner = np.concatenate([[0], owner]).astype(np.int32)  # of each part its shard

    def dealt(batches):
        for batch in batches:
            n = batch.num_columns
            part = _slots(np.asarray(batch.column(n - 3)), np.asarray(batch.column(n - 2)), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), pa.array(owner[part])], names=[*batch.schema.names, "__wl_part", "shard"])

    placed = keyed.mapInArrow(dealt, keyed.withColumns({"__wl_part": F.lit(0), "shard": F.lit(0)}).schema)
    counts = _part_counts(narrow, bounds, owner)
    start = F.sum("rows").over(Window.partitionBy("own").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(counts.select(F.col("part").alias("__wl_part"), F.coalesce(start, F.lit(0)).alias("__wl_start")), "starts")
    tie = [c for c in names if docs.schema[c].dataType.typeName() not in ("map", "variant")]
    rank = F.row_number().over(Window.partitionBy("__wl_part").orderBy("__wl_a", "__wl_b", *tie))
    numbered = placed.withColumn("__wl_rank", rank).join(broadcast_rows(starts, MOST_PARTS), "__wl_part")
    return numbered.select(*names, "shard", (F.col("__wl_start") + F.col("__wl_rank") - 1).cast("long").alias("slot"))


def _part_counts(narrow: DataFrame, bounds: np.ndarray, owner: np.ndarray) -> DataFrame:
    """part, own (its shard), rows of every part that has rows."""

    def counted(batches):
        for found in _below(batches, bounds):
            part = np.asarray(found.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(owner[part]), found.column(2)], names=["part", "own", "rows"])

    return narrow.mapInArrow(counted, "part int, own int, rows long").groupBy("part", "own").agg(F.sum("rows").alias("rows"))
