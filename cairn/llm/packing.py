"""Best-fit packing whose bins refuse documents of the same cluster and too many of one source."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, keyed, real_id

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one task packs together.
SHARD_ROWS = 4096
#: Documents of one source that a bin takes at most: one bitmap for each count below it.
SOURCE_LIMIT = 2


def best_fit(rows: list[tuple[int, int, int]], capacity: int, source_limit: int) -> list[tuple[int, int]]:
    """(length, source number, cluster number or -1) in the order to place them -> (bin, offset).

    Bins stand in the order of their residual room. A search starts at the successor of the wanted length and goes
    on to roomier bins until one whose bitmaps allow the document; without one a new bin opens.
    """
    room: list[tuple[int, int]] = []  # (residual, bin), sorted
    sources, clusters, placed = [], [], []
    for length, source, cluster in rows:
        bit, twin = 1 << source, (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(room, (length, -1))
        while at < len(room) and (sources[room[at][1]][-1] & bit or clusters[room[at][1]] & twin):
            at += 1
        if at < len(room):
            left, found = room.pop(at)
        else:
            left, found = capacity, len(sources)
            sources.append([0] * source_limit)
            clusters.append(0)
        plane = next(k for k, bits in enumerate(sources[found]) if not bits & bit)
        sources[found][plane] |= bit
        clusters[found] |= twin
        placed.append((found, capacity - left))
        if left > length:
            insort(room, (left - length, found))
    return placed


def pack(
    docs: DataFrame, capacity: int = 2048, shard_rows: int = SHARD_ROWS, source_limit: int = SOURCE_LIMIT, cluster: Column | None = None
) -> DataFrame:
    """Packs every document's words into bins of `capacity` words, longest pieces first.

    A document longer than a bin is cut into full pieces, each a bin of its own, and a remainder. Remainders are
    packed best-fit in shards of about `shard_rows` documents, dealt by a hash of id, text and place in the table, so no
    source, group of copies or repeated row gathers in one task. The tightest compatible bin is the tightest of the
    shard. A bin takes no two documents of one cluster and at most `source_limit` of one source. `cluster` says which
    documents are one cluster (such as the component_id of the Jaccard join, as a column of docs; null: none);
    without it, those with equal lower-cased texts are.

    Null or wordless texts give one row with no bin and length 0. Null sources are one source. Repeated rows are
    packed each for itself, in different bins. Extra columns are not read; an empty table gives an empty result.
    """
    same = F.xxhash64(F.lower(F.coalesce("text", F.lit("")))) if cluster is None else cluster.cast("long")
    slim = keyed(
        docs,
        F.col("source").cast("string").alias("source"),
        same.alias("cluster"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
    )
    slim = cut(slim)  # once written, rows keep their places
    shards = max(1, -(-slim.count() // shard_rows))
    slim = slim.withColumn("shard", F.pmod(F.xxhash64("id", "h", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    schema = "id long, h long, source string, cluster long, n_words long, piece int, start long, length long, bin long, bin_offset int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "h"], kind="stable").reset_index(drop=True)
        source = pd.factorize(pdf["source"].fillna("\0"))[0]
        number, _ = pd.factorize(pdf["cluster"])
        twins = (pdf["cluster"].duplicated(keep=False) & pdf["cluster"].notna()).to_numpy()
        rest = (pdf["n_words"] % capacity).to_numpy()
        order = [i for i in sorted(range(len(pdf)), key=lambda i: -rest[i]) if rest[i]]
        spots = dict(zip(order, best_fit([(int(rest[i]), int(source[i]), int(number[i]) if twins[i] else -1) for i in order], capacity, source_limit), strict=True))
        base = int(pdf["shard"].iloc[0]) << 32
        bins = 1 + max((b for b, _ in spots.values()), default=-1)
        out = []
        for i, n in enumerate(pdf["n_words"]):
            full = int(n) // capacity
            for k in range(full):
                out.append((i, k, k * capacity, capacity, base + bins, 0))
                bins += 1
            if i in spots:
                out.append((i, full, full * capacity, int(rest[i]), base + spots[i][0], spots[i][1]))
            elif not full:
                out.append((i, 0, 0, 0, None, None))
        cols = pd.DataFrame(out, columns=["row", "piece", "start", "length", "bin", "bin_offset"]).astype({"bin": "Int64", "bin_offset": "Int64"})
        return pdf.loc[cols["row"], ["id", "h", "source", "cluster", "n_words"]].reset_index(drop=True).join(cols.drop(columns="row"))

    out = slim.groupBy("shard").applyInPandas(one, schema)
    return out.select(real_id().alias("doc_id"), *out.columns[2:])
