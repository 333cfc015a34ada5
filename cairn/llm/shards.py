"""Sharding: minimax contiguous partition over ordered atomic groups of equal texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cairn.llm.common import cut

#: Hex digits by which groups are summed at a time: at most 4,096 sums for each prefix that is split reach the driver.
DIGITS = 3


class _Line:
    """Sums of neighbouring groups in key order; an item is one group or a key prefix that can be split."""

    def __init__(self, fetch):
        self.fetch = fetch
        self.set(fetch([""]))

    def set(self, items: list[tuple[str, int, bool]]) -> None:
        self.items = sorted(items)
        self.ends = np.concatenate(([0], np.cumsum([x[1] for x in self.items], dtype=np.int64)))

    def split(self, which: set[int]) -> None:
        fresh = self.fetch([self.items[i][0] for i in sorted(which)])
        self.set([x for i, x in enumerate(self.items) if i not in which] + fresh)

    def reach(self, start: int, capacity: int) -> int:
        return int(np.searchsorted(self.ends, self.ends[start] + capacity, "right")) - 1

    def fits(self, capacity: int, shards: int, start: int = 0) -> tuple[bool, bool, set[int]]:
        """Whether a greedy walk surely fits, whether it might, and the items that must be split to tell."""
        n, open_items, answer = len(self.items), set(), []
        for optimistic in (False, True):
            at = start
            for _ in range(shards):
                at = self.reach(at, capacity)
                if at < n and not self.items[at][2]:
                    open_items.add(at)
                    at += optimistic
                if at >= n:
                    break
            answer.append(at >= n)
        return answer[0], answer[1], open_items


def _cuts(line: _Line, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity, and the first key of every shard but the first."""
    total = int(line.ends[-1])
    lo, hi = max(-(-total // shards), max((x[1] for x in line.items if x[2]), default=0)), max(total, 1)
    while lo < hi:
        mid = (lo + hi) // 2
        sure, maybe, unclear = line.fits(mid, shards)
        if sure:
            hi = mid
        elif not maybe:
            lo = mid + 1
        else:
            line.split(unclear)
    while not line.fits(lo, shards)[0]:
        line.split(line.fits(lo, shards)[2])
    start, cuts, n = 0, [], len(line.items)
    for s in range(shards - 1):
        most = line.reach(start, lo)
        even = int(np.argmin(np.abs(line.ends - (line.ends[start] + (total - line.ends[start]) / (shards - s)))))
        even = max(start, min(even, most))
        start = even if line.fits(lo, shards - s - 1, even)[0] else most
        cuts.append(line.items[start][0] if start < n else "g")  # "g" follows every hex digit
    return lo, cuts


def minimax_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Deals documents into shards so that the largest shard, in bytes, is as small as can be.

    Groups of equal texts are atomic and stand in the order of their SHA-256; a shard is a run of groups. The
    smallest feasible capacity is found by binary search with a greedy check. The driver works on sums by key
    prefix (4,096 at first) and asks for finer sums only where a cut falls inside a prefix, so the answer is exact
    with bounded memory. Within that capacity cuts go where sizes are most even.

    Slots are counted where the rows lie: each part of the table has a first slot in each shard, so nothing is sorted
    and a common id or text makes no hot key. The driver holds one count for each part and shard.

    Null texts count as empty ones: size 1, checksum 0, one group. Repeated rows each get a slot. An empty table
    gives an empty result. Other columns are not read. A group larger than its share fills a shard alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
            F.spark_partition_id().alias("part"),
        )
    )  # the parts are written, so they stay as they are

    def fetch(prefixes: list[str]) -> list[tuple[str, int, bool]]:
        depth = len(prefixes[0]) if len({len(p) for p in prefixes}) == 1 else None
        if depth is None:
            return [x for d in {len(p) for p in prefixes} for x in fetch([p for p in prefixes if len(p) == d])]
        part = base.filter(F.substring("key", 1, depth).isin(prefixes)) if depth else base
        sums = part.groupBy(F.substring("key", 1, depth + DIGITS).alias("p")).agg(
            F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b")
        )
        return [(r.p, r.size, r.a == r.b) for r in sums.collect()]

    _, cuts = _cuts(_Line(fetch), shards)
    shard = sum(((F.col("key") >= c).cast("int") for c in cuts), F.lit(0))
    dealt = base.withColumn("shard", shard)
    counts: dict[int, np.ndarray] = {}
    for r in dealt.groupBy("part", "shard").count().collect():
        counts.setdefault(r["part"], np.zeros(shards, dtype=np.int64))[r["shard"]] = r["count"]
    first, before = {}, np.zeros(shards, dtype=np.int64)
    for part in sorted(counts):
        first[part] = before
        before = before + counts[part]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: dict[tuple[int, int], int] = {}
        for batch in batches:
            keys = pd.DataFrame({c: batch.column(c).to_numpy() for c in ("part", "shard")})
            slot = np.empty(len(keys), dtype=np.int64)
            for (part, shard), at in keys.groupby(["part", "shard"]).indices.items():
                begin = ahead.setdefault((part, shard), int(first[part][shard]))
                slot[at] = begin + np.arange(len(at))
                ahead[part, shard] = begin + len(at)
            yield batch.append_column("slot", pa.array(slot))

    numbered = dealt.mapInArrow(number, StructType([*dealt.schema, StructField("slot", LongType())]))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
