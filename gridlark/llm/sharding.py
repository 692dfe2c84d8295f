"""Sharding by minimax contiguous partition of ordered atomic groups, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import Scratch, carried, positions, running_totals, table

#: Into how many cells the total is divided, and later the parts in doubt.
CELLS = 1 << 16


class Ends:
    """Where groups end, as running totals, in cells: the driver knows the first and the last end in each.

    A place between a cell's first and last end is in doubt. ``refine`` divides
    such cells again, ``split`` asks for the ends around single places; each is
    one scan, filtered to the ranges it asks for (the rows are in order, so
    that files and row groups outside are passed over), and at most about
    ``CELLS`` rows of three numbers come to the driver, whatever the input.
    """

    def __init__(self, groups: DataFrame, total: int) -> None:
        self.groups, self.total = groups, total
        self.first = self.last = np.zeros(0, np.int64)
        self._replace(0, 0, self._cells([(1, total)], max(1, -(-total // CELLS))))

    def _cells(self, ranges: list[tuple[int, int]], width: int) -> np.ndarray:
        """(first, last) of the ends in each cell of that width within each of the ranges."""
        here = reduce(lambda a, b: a | b, [F.col("end").between(lo, hi) for lo, hi in ranges])
        part = F.size(F.filter(F.lit([lo for lo, _ in ranges]).cast("array<bigint>"), lambda lo: lo <= F.col("end")))
        cell = F.floor((F.col("end") - 1) / F.lit(width))
        found = self.groups.where(here).groupBy(part.alias("part"), cell.alias("cell")).agg(F.min("end").alias("first"), F.max("end").alias("last"))
        rows = found.select("first", "last").toArrow()
        out = np.column_stack([rows.column(k).to_numpy() for k in (0, 1)]).astype(np.int64).reshape(-1, 2)
        return out[np.argsort(out[:, 0])]

    def _replace(self, lo: int, hi: int, cells: np.ndarray) -> None:
        self.first = np.concatenate([self.first[:lo], cells[:, 0], self.first[hi:]])
        self.last = np.concatenate([self.last[:lo], cells[:, 1], self.last[hi:]])

    def from_(self, place: int) -> tuple[int, int]:
        """Between what the smallest end at or above a place lies; 0 for places below 1."""
        if place <= 0:
            return 0, 0
        i = int(np.searchsorted(self.last, place))
        return (int(self.first[i]),) * 2 if self.first[i] >= place else (place, int(self.last[i]))

    def up_to(self, place: int) -> tuple[int, int]:
        """Between what the largest end at or below a place lies; 0 if there is none."""
        i = int(np.searchsorted(self.first, place, side="right")) - 1
        if i < 0:
            return 0, 0
        return (int(self.last[i]),) * 2 if self.last[i] <= place else (int(self.first[i]), place)

    def refine(self, ranges: list[tuple[int, int]]) -> None:
        """Divide the cells with ends in any of the ranges."""
        spans: list[list[int]] = []  # cells lo .. hi - 1, apart from each other
        for a, b in sorted(ranges):
            lo, hi = int(np.searchsorted(self.last, a)), int(np.searchsorted(self.first, b, side="right"))
            if lo < hi and (self.first[lo:hi] < self.last[lo:hi]).any():
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        if not spans:
            return
        asked = [(int(self.first[lo]), int(self.last[hi - 1])) for lo, hi in spans]
        width = -(-sum(b - a + 1 for a, b in asked) // CELLS)
        longest = max(int((self.last[lo:hi] - self.first[lo:hi]).max()) + 1 for lo, hi in spans)
        cells = self._cells(asked, max(1, min(width, longest // 2)))
        for (lo, hi), (a, b) in zip(reversed(spans), reversed(asked), strict=True):
            self._replace(lo, hi, cells[(cells[:, 0] >= a) & (cells[:, 1] <= b)])

    def split(self, places: list[int]) -> None:
        """Learn the ends around each place that is in doubt."""
        doubt = sorted({p for p in places if len(set(self.up_to(p))) > 1})
        if not doubt:
            return
        at = [int(np.searchsorted(self.first, p, side="right")) - 1 for p in doubt]
        here = reduce(lambda a, b: a | b, [F.col("end").between(int(self.first[i]), int(self.last[i])) for i in set(at)])
        asks = [c for k, p in enumerate(doubt) for c in (F.max(F.when(F.col("end") <= p, F.col("end"))).alias(f"a{k}"), F.min(F.when(F.col("end") > p, F.col("end"))).alias(f"b{k}"))]
        row = self.groups.where(here).agg(*asks).first()
        for k in reversed(range(len(doubt))):
            i = int(np.searchsorted(self.first, doubt[k], side="right")) - 1
            self._replace(i, i + 1, np.array([[self.first[i], row[f"a{k}"]], [row[f"b{k}"], self.last[i]]]))


def filled(ends: Ends, capacity: int, shards: int, surely: bool) -> list[int] | None:
    """Where shards begin if each, from the end, takes what the capacity holds; None if they are not enough.

    Ends in doubt are taken where they help most, or, ``surely``, least.
    """
    out = [ends.total]
    while out[-1] > 0:
        begin = ends.from_(out[-1] - capacity)[1 if surely else 0]
        if len(out) > shards or begin >= out[-1]:
            return None
        out.append(begin)
    return out


def smallest_capacity(ends: Ends, shards: int, widest: int) -> tuple[int, list[int]]:
    """The smallest capacity with which greedy filling, from the end, needs at most ``shards`` shards.

    Two binary searches, on the driver, find from which capacity on the known
    cells allow enough shards and from which on they surely do; the cells that
    the fillings between these two can end in are divided, until the two are
    one. Also returns the end each shard but the last must reach.
    """

    def search(low: int, high: int, surely: bool) -> int:
        """The smallest capacity above ``low`` that fits, given that ``high`` does."""
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if filled(ends, mid, shards, surely) else (mid, high)
        return high

    low = max(widest, -(-ends.total // shards)) - 1  # too small
    while True:
        top = -(-ends.total // shards) + widest  # fits, but perhaps not surely
        while not filled(ends, top, shards, True):
            top = min(2 * top, ends.total)
        high = search(low, top, True)
        low = search(low, high, False) - 1
        best, worst = filled(ends, high, shards, False), filled(ends, low + 1, shards, True)
        if high == low + 1 and best == worst:
            return high, [0] * (shards + 1 - len(best)) + best[::-1]
        worst = worst or [ends.total] * len(best)  # nothing is known of it
        worst += [0] * (len(best) - len(worst))
        ends.refine([(best[k], worst[k]) for k in range(1, len(best))])


def cut_points(ends: Ends, shards: int, capacity: int, least: list[int]) -> list[int]:
    """Where each shard ends: at the end nearest below its even share, as the capacity allows.

    ``least`` are the cuts of greedy filling from the end: a cut at or after
    them leaves no more than the later shards can hold.
    """
    even = [ends.total * (j + 1) // shards for j in range(shards)]
    ends.split(even)
    cuts, at = [], 0
    for j in range(shards):
        cut = max(ends.up_to(even[j])[0], least[j + 1], at)
        if cut - at > capacity:
            ends.split([at + capacity])
            cut = ends.up_to(at + capacity)[0]
        cuts.append(cut)
        at = cut
    return cuts


def shard_groups(docs: DataFrame, shards: int, size: Column, group: Column, keep: list[str], doc_id: str = "doc_id") -> DataFrame:
    """Deal documents into ``shards`` contiguous shards of groups that are never split.

    Groups are ordered by ``group`` (not null), documents within by ``doc_id``;
    sizes are not null, and below 1 count as 1 in the balance.
    The largest shard is as small as the atomic groups allow. The groups'
    running totals are made over the table of groups; bounded summaries of
    them (see ``Ends``), the cuts and the groups at the cuts reach the driver.
    A document finds its shard by comparing its group with those at the cuts:
    no join, and no task holds a group or a shard, as documents are spread over range partitions.

    Returns the columns ``keep`` and size, shard (0 .. shards-1) and slot (gapless from 0 in
    each shard). Null doc_ids come first; repeated rows get slots of their
    own. Later shards may be empty if there are fewer groups than shards; an
    empty input gives an empty result. Texts are read once, whatever their length.
    Columns to keep may not be called size, shard or slot; others may.
    """
    kept = {f"_k{i}": F.col(c) for i, c in enumerate(carried(docs, keep, ["size", "shard", "slot"]))}
    base = docs.select(*[c.alias(k) for k, c in kept.items()], docs[doc_id].alias("_order"), group.alias("_group"), size.cast("long").alias("_size"))
    with Scratch(docs.sparkSession) as scratch:
        base = scratch.table(base, "documents")
        groups = base.groupBy("_group").agg(F.sum(F.greatest("_size", F.lit(1))).alias("bytes"))
        groups = running_totals(groups, ["_group"], {"end": "bytes"}, "ranked", scratch.folder).select("_group", "bytes", "end")
        groups = scratch.table(groups, "groups")
        total, widest = groups.agg(F.max("end"), F.max("bytes")).first()
        shard = F.lit(0)
        if total:
            ends = Ends(groups, total)
            cuts = cut_points(ends, shards, *smallest_capacity(ends, shards, widest))[:-1]
            at = {r["end"]: r["_group"] for r in groups.where(F.col("end").isin(sorted(set(cuts)))).select("end", "_group").collect()}  # a row per cut
            begun = [at[c] for c in cuts if c]
            shard = F.lit(shards - 1 - len(begun))  # shards whose begin is 0, less one
            if begun:
                shard = shard + F.size(F.filter(F.array(*map(F.lit, begun)), lambda g: g < F.col("_group")))
        out = positions(base.withColumn("_shard", shard), "_shard", ["_group", "_order"], "_slot", folder=scratch.folder)
        return table(out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], F.col("_size").alias("size"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot")), "sharded")


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def text_group(text: Column) -> Column:
    """Equal texts, and only they, share a group; null is a group of its own."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts stay together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = shard_groups(docs, 40, text_size(F.col("text")), text_group(F.col("text")), ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
