"""N-gram Jaccard join: T-occurrence search over inverted lists, and the components of its links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textkit as tk
from cairn.llm.common import Scratch, components, cut, keyed, real_id, row_columns, slim, whole_row

#: Share of a set's least hashes looked at beyond what any partner may lack.
SLACK = 0.12
#: Sets, and elements of them all, of one candidate group that a task compares with each other or with as many others.
BLOCK, ELEMENTS = 256, 1 << 19
#: Weighs list length against the number of long lists when the lists are divided; long lists probed at a time.
MU, PROBED = 1.0, 16


def shingle_sets(raw: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words are one shingle, none are no shingle."""
    w, bounds = tk.words(raw, tk.SPACES, True)
    g = tk.grams(w, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(g[a : b - k + 1]) if b - a >= k else tk.grams(w[a:b], b - a) if b > a else g[:0]


def set_id(x: np.ndarray) -> tuple[int, int]:
    """128 bits that are the same for equal sets."""
    total = (np.add.reduce(tk._mix(x + s), dtype=tk.U) for s in tk.STEPS)
    return tuple(int(tk._mix(np.array([t + tk.U(len(x))])).view(np.int64)[0]) for t in total)


def _overlap(a, b, num: int, den: int):
    """Least intersection of sets of sizes a and b with den * I >= num * U."""
    return -(-num * (a + b) // (den + num))


def divide_skip(
    sets: list[np.ndarray], first: int, num: int, den: int, across: bool, weights: np.ndarray | None = None
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs that join the linked sets as a forest, and for each set the sum of its partners' weights.

    With `across`, links sets before `first` with later ones. Each set searches the inverted lists of its elements for
    sets that reach the needed overlap T: the L longest lists are put aside, the others are merged, and sets found
    T - L times or more are looked up in the long lists by binary search, until they can no longer reach their T. Every
    pair that may link is verified; without weights (all zeros come back) only pairs not joined through others yet.
    """
    m = len(sets)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=m)
    elements, rank = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    order = np.lexsort((owner, rank))
    lists, begin = owner[order].astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(rank, minlength=len(elements)))))
    keys = rank[order] * m + lists  # sorted
    bounds = np.concatenate(([0], np.cumsum(size)))
    parent, links, sums = list(range(m)), [], np.zeros(m, dtype=np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x in range(first if across else m):
        own = rank[bounds[x] : bounds[x + 1]]
        lengths = begin[own + 1] - begin[own]
        own, lengths = own[lengths > 1], lengths[lengths > 1]
        need = -(-num * int(size[x]) // den)  # the least overlap with a partner of any size
        if len(own) < need:
            continue
        own = own[np.argsort(lengths, kind="stable")]
        longest = int(lengths.max())
        aside = min(need - 1, int(need / (MU * math.log2(max(longest, 2)) + 1)))
        short, long = own[: len(own) - aside], own[len(own) - aside :]
        n = begin[short + 1] - begin[short]
        # a stable sort merges the sorted lists
        merged = np.sort(lists[np.repeat(begin[short] - np.cumsum(n) + n, n) + np.arange(n.sum())], kind="stable")
        new = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        found, total = merged[new].astype(np.int64), np.diff(np.concatenate((new, [len(merged)])))
        wanted = _overlap(int(size[x]), size[found], num, den)
        may = (total + aside >= wanted) & (found >= first if across else found > x)
        may &= (size[found] * den >= size[x] * num) & (size[x] * den >= size[found] * num)
        if weights is None and may.any():
            mine = root(x)
            may &= np.fromiter((root(y) != mine for y in found.tolist()), dtype=bool, count=len(found))
        found, total, wanted = found[may], total[may], wanted[may]
        for at in range(0, len(long), PROBED):
            if not len(found):
                break
            part = long[at : at + PROBED]
            probe = (part[:, None] * m + found[None, :]).ravel()
            spot = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            total = total + (keys[spot] == probe).reshape(len(part), -1).sum(0)
            may = total + (len(long) - at - len(part)) >= wanted
            found, total, wanted = found[may], total[may], wanted[may]
        if weights is not None:
            found = found[total >= wanted]
            sums[x] += weights[found].sum()
            sums[found] += weights[x]
        else:
            found = found[total >= wanted]
        for y in found.tolist():
            if root(y) != root(x):
                parent[root(y)] = root(x)
                links.append((x, y))
    return links, sums


def candidate_groups(sets: DataFrame, need: Column) -> DataFrame:
    """(sid, root, members): sets connected by filed hashes. sets: sid, n, hashes; linked sets share `need` hashes or more.

    Of the hashes that other sets show too, rarest first, each set files all but need - 1: then linked sets have a filed
    hash in common. Frequent passages come last in that order and are rarely filed. Sets with fewer shared hashes than
    they need, or without a filed one in common, are left out: they link with none.
    """
    hashes = sets.select("sid", "n", F.explode("hashes").alias("t"))
    frequent = cut(hashes.groupBy("t").count().filter("count > 1"))
    shared = hashes.join(frequent, "t").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("count", "t"))).alias("s"))
    filed = cut(
        shared.filter(F.size("s") >= need)
        .select("sid", F.explode(F.slice("s", 1, F.size("s") - need + 1)).alias("x"))
        .select("sid", F.col("x.t").alias("t"))
    )
    heads = cut(filed.groupBy("t").agg(F.min("sid").alias("head"), F.max("sid").alias("other")).filter("head <> other").select("t", "head"))
    edges = filed.join(heads, "t").filter("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    edges = cut(edges.distinct())
    groups = components(None, edges)
    n = groups.count()
    members = cut(slim(groups, n).groupBy("root").agg(F.count("*").alias("members")))
    return cut(slim(groups, n).join(slim(members, n), "root").select(F.col("id").alias("sid"), "root", "members"))


def similar_components(docs: DataFrame, k: int, num: int, den: int = 100, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, and id and h of `keyed`, and root, one for each component: components
    of texts whose shingle sets have den * I >= num * U. n_links: other documents that a document links with.

    Exact, by 64-bit hashes of shingles:
    1. Equal sets (128 bits) are one set from here on, so copies cost nothing further.
    2. Each set shows its least hashes, a share of 1 - num/den + SLACK. Two linked sets have at least
       SLACK * num/den of their size among these in common. Sets that share so many, through their rarer hashes, form
       candidate groups.
    3. Groups of more than BLOCK sets are divided again in the same way by their whole sets, which must have num/den of
       their hashes in common.
    4. Whole sets of each group are compared by T-occurrence search; groups still over BLOCK sets are cut into blocks,
       and every pair of blocks is a task. Every link between different sets is verified and counted, with the number
       of documents on its other side; links of copies follow from their numbers. A task gives back a forest of its
       links and its counts, so what is shuffled afterwards grows with the sets, not with the links. Without
       `count_links` pairs already joined are passed over, and n_links is null.

    Null and empty texts have no shingles, link with nothing and are their own component; a null doc_id counts only
    where no other id is in the component. Rows equal in doc_id and text are copies. An empty table gives an
    empty result; columns other than doc_id and text are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        return cut(_components(docs, k, num, den, count_links, scratch))


def _components(docs: DataFrame, k: int, num: int, den: int, count_links: bool, scratch: Scratch) -> DataFrame:
    docs = keyed(docs, F.coalesce("text", F.lit("")).alias("text"))
    share = 1 - num / den + SLACK

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, raw in tk.slices(pdf["text"]):
                rows = [(len(x), *set_id(x), x[: math.ceil(share * len(x))].view(np.int64)) for x in shingle_sets(raw, k)]
                out = pd.DataFrame(rows, columns=["n", "s1", "s2", "hashes"])
                at = pdf.iloc[first : first + len(raw)]
                yield out.assign(id=at["id"].array, h=at["h"].array)[["id", "h", "n", "s1", "s2", "hashes"]]

    with Scratch(docs.sparkSession) as early:
        seen = early.write(docs.mapInPandas(shown, "id long, h long, n long, s1 long, s2 long, hashes array<long>"))
        members = scratch.write(seen.drop("hashes"))
        rep = F.min(F.struct(F.col("h").bitwiseAND(F.lit(1)).alias("none"), "id", "h")).alias("rep")
        one = seen.filter("n > 0").groupBy("s1", "s2").agg(rep, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("hashes").alias("hashes"))
        # numbers that stay, because they are written
        sets = scratch.write(one.select(F.monotonically_increasing_id().alias("sid"), "s1", "s2", "copies", "n", "rep.id", "rep.h", "hashes"))
    groups = candidate_groups(sets, F.greatest(F.lit(1), F.ceil(F.col("n") * (SLACK * num / den) - 1e-9)).cast("int"))
    picked = groups.join(sets.select("sid", "n", "copies", "id", "h"), "sid")
    # the join leaves equal rows side by side, so dropping repeats shuffles nothing more
    carried = ["sid", "n", "copies", "root", "members"]
    texts = docs.join(picked, ["id", "h"]).dropDuplicates(["id", "h"]).select(*carried, "text")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, raw in tk.slices(pdf["text"]):
                yield pdf.iloc[first : first + len(raw)][carried].assign(hashes=[x.view(np.int64) for x in shingle_sets(raw, k)])

    full = scratch.write(texts.mapInPandas(whole, "sid long, n long, copies long, root long, members long, hashes array<long>"))
    few, many = full.filter(F.col("members") <= BLOCK), full.filter(F.col("members") > BLOCK)
    if not many.isEmpty():
        finer = candidate_groups(many.select("sid", "n", "hashes"), F.greatest(F.lit(1), F.ceil(F.col("n") * num / den)).cast("int"))
        few = few.unionByName(many.drop("root", "members").join(finer, "sid"))
    totals = few.groupBy("root").agg(F.sum("n").alias("elements"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("elements") / ELEMENTS)).cast("int")
    full = few.join(cut(totals), "root").select(
        "sid", "root", "copies", "hashes", blocks.alias("blocks"), F.pmod(F.xxhash64("sid"), blocks).cast("int").alias("block")
    )
    pairs = full.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "sid", "root", "block", "copies", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "hashes"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "sid"])
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        weights = pdf["copies"].to_numpy() if count_links else None
        found, sums = divide_skip([np.asarray(x).view(tk.U) for x in pdf["hashes"]], int((pdf["block"] == i).sum()), num, den, i != j, weights)
        sid = pdf["sid"].to_numpy()
        rows = [(sid[a], sid[b], 0) for a, b in found] + [(sid[x], None, int(sums[x])) for x in np.flatnonzero(sums)]
        return pd.DataFrame(rows, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    results = cut(pairs.groupBy("root", "i", "j").applyInPandas(compare, "a long, b long, n long"))
    links, counts = results.filter("b IS NOT NULL").select("a", "b"), results.filter("b IS NULL")
    roots = components(None, links)
    counted = counts.groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("others"))
    least = sets.select("sid", "s1", "s2", "copies", real_id().alias("doc_id")).join(roots.withColumnRenamed("id", "sid"), "sid", "left")
    least = cut(least.join(counted, "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    ids = cut(least.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    n_links = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
    named = cut(least.join(ids, "root").select("s1", "s2", "root", "component_id", (n_links if count_links else F.lit(None).cast("long")).alias("n_links")))
    some = F.col("n") > 0
    return members.join(named, ["s1", "s2"], "left").select(
        real_id().alias("doc_id"), "id", "h", "root", F.col("n").alias("n_shingles"),
        F.when(some, F.col("component_id")).otherwise(real_id()).alias("component_id"),
        F.when(some, F.col("n_links")).when(F.lit(count_links), 0).alias("n_links"),
    )


def keep_one_each(docs: DataFrame, k: int, num: int, den: int = 100) -> DataFrame:
    """The documents, all columns, without near duplicates: of each component the smallest doc_id stays.

    Of several rows with that id the one with the least text hash stays; documents without shingles all stay.
    """
    found = similar_components(docs, k, num, den, count_links=False)
    least = F.struct(F.isnull("doc_id").alias("none"), "id", "h")
    alone = F.when(F.col("n_shingles") == 0, F.struct("id", "h"))
    stay = cut(found.groupBy("root", alone.alias("alone")).agg(F.min(least).alias("m")).select("m.id", "m.h"))
    kept = keyed(docs, whole_row(docs).alias("row")).join(stay, ["id", "h"], "left_semi")
    return kept.select(*row_columns(docs.columns))
