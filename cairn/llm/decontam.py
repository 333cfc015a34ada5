"""Benchmark decontamination: spaced-seed hashing with substitution-tolerant verification."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textkit as tk
from cairn.llm.common import cut, keyed, real_id, row_columns, whole_row

T = TypeVar("T")
#: A leak is LENGTH aligned words of which at most SUBSTITUTED differ.
LENGTH, SUBSTITUTED = 13, 2
#: Fixed masks; words under 0 are ignored. Together they lose nothing: whichever 2 of 13 words differ, one of the
#: masks fits somewhere among the 13 without touching them (a test checks all 78 cases).
MASKS = ("111001011", "101100111")
#: Shorter items count as a whole, with as great a share of differing words; below ALONE words only as a whole document.
ALONE = 5
#: Words of benchmark text that are broadcast at a time; more are searched in further rounds. Longer items are cut into
#: pieces of PART words that overlap by LENGTH - 1.
ROUND_WORDS, PART = 1_000_000, 50_000
PAIRS = 1 << 20
#: Leading bits of a hash by which most words are passed over.
BITS = 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAK = "item_id long, start int, n_words int, n_equal int, differ array<int>"


def differing(n: int) -> int:
    """How many of n aligned words may differ."""
    return SUBSTITUTED if n >= LENGTH else SUBSTITUTED * n // LENGTH


def masks_of(n: int) -> tuple[str, ...]:
    """Masks for items of n words. For shorter items: whole words, or every other one where one word may differ."""
    if n >= LENGTH:
        return MASKS
    return ("1" * n,) if not differing(n) else (("10" * n)[:n], ("01" * n)[:n])


def _seeds(w: np.ndarray, mask: str) -> np.ndarray:
    n = len(w) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=tk.U)
    out = np.zeros(n, dtype=tk.U)
    for j, keep in enumerate(mask):
        if keep == "1":
            out = tk._mix(out * tk.GOLD + w[j : j + n])
    return out


class Index:
    """Seeds of benchmark items or pieces of them, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.number = np.unique(np.array([i for i, _ in items], dtype=np.int64), return_inverse=True)
        self.w, self.bounds = tk.words([t.encode() for _, t in items], tk.MARKS, True)
        size = np.diff(self.bounds)
        self.item, self.seeds = np.repeat(np.arange(len(items)), size), []
        masks = [(m, size >= LENGTH) for m in MASKS] + [(m, size == n) for n in range(1, LENGTH) for m in masks_of(n)]
        for mask, own in masks:
            h = _seeds(self.w, mask)
            item = self.item[: len(h)]
            at = np.flatnonzero(own[item] & (np.arange(len(h)) + len(mask) <= self.bounds[item + 1]))
            if len(at):
                order = np.argsort(h[at], kind="stable")
                self.seeds.append((mask, h[at][order], at[order]))
        self.tables = None  # made in each worker

    def leaks(self, w: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int, int, list[int]]]]:
        """For each text: (item, first word, words, equal words, places of differing words) of each leak."""
        if self.tables is None:
            self.tables = [np.zeros(1 << BITS, dtype=bool) for _ in self.seeds]
            for x, (_, h, _) in zip(self.tables, self.seeds, strict=True):
                x[(h >> tk.U(64 - BITS)).astype(np.int64)] = True
        marks: list[dict[int, np.ndarray]] = [{} for _ in range(len(bounds) - 1)]
        seen: set[tuple[int, int, int]] = set()
        for (mask, hashes, places), table in zip(self.seeds, self.tables, strict=True):
            h = _seeds(w, mask)
            at = np.flatnonzero(table[(h >> tk.U(64 - BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends, done = np.cumsum(n), 0
            while done < len(at):  # a bounded number of hits at a time, however often words repeat
                to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
                k = n[done:to]
                word = np.repeat(at[done:to], k)
                place = places[np.repeat(lo[done:to] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                text = np.searchsorted(bounds, word, "right") - 1
                for t, i, d in np.unique(np.stack((text, self.item[place], word - place)), axis=1).T.tolist():
                    if (t, i, d) not in seen:
                        seen.add((t, i, d))
                        self._verify(w, bounds, t, i, d, marks[t])
                done = to
        return [[(int(self.ids[i]), *x) for i, found in sorted(of.items()) for x in self._stretches(found)] for of in marks]

    def _verify(self, w: np.ndarray, bounds: np.ndarray, t: int, i: int, d: int, found: dict[int, np.ndarray]) -> None:
        """Extends a hit along its diagonal and marks, for each word of the text: in a good window, in one that goes on, equal."""
        first, last = self.bounds[i], self.bounds[i + 1]
        lo, hi = max(bounds[t], first + d), min(bounds[t + 1], last + d)
        length = min(LENGTH, last - first)
        if hi - lo < length or (length < ALONE and bounds[t + 1] - bounds[t] != length):
            return
        same = w[lo:hi] == self.w[lo - d : hi - d]
        equal = np.concatenate(([0], np.cumsum(same)))
        good = np.flatnonzero(equal[length:] - equal[:-length] >= length - differing(length))
        if not len(good):
            return
        n = int(self.number[i])
        if n not in found:
            found[n] = np.zeros((3, bounds[t + 1] - bounds[t]), dtype=bool)
        at = slice(lo - bounds[t], hi - bounds[t])
        for row, size in ((0, length), (1, length - 1)):
            edge = np.zeros(hi - lo + 1, dtype=np.int32)
            edge[good] += 1
            edge[good + size] -= 1
            cover = np.cumsum(edge[:-1]) > 0
            found[n][row, at] |= cover
            if row == 0:
                found[n][2, at] |= cover & same

    @staticmethod
    def _stretches(found: np.ndarray) -> list[tuple[int, int, int, list[int]]]:
        """Runs of words that windows hold together."""
        cover, goes_on, equal = found
        joined = np.concatenate(([False], goes_on[:-1]))
        starts = np.flatnonzero(cover & ~joined)
        ends = np.flatnonzero(cover & ~goes_on) + 1
        return [(int(a), int(b - a), int(equal[a:b].sum()), (a + np.flatnonzero(~equal[a:b])).tolist()) for a, b in zip(starts, ends, strict=True)]


def merged(stretches: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int]]:
    """(start, words, places of differing words) from several rounds -> (start, words, equal words) where they overlap."""
    out, i, rows = [], 0, sorted(stretches)
    while i < len(rows):
        start, end, group = rows[i][0], rows[i][0] + rows[i][1], [rows[i]]
        while i + 1 < len(rows) and rows[i + 1][0] < end:
            i += 1
            group.append(rows[i])
            end = max(end, rows[i][0] + rows[i][1])
        equal = np.zeros(end - start, dtype=bool)
        for a, n, differ in group:
            own = np.ones(n, dtype=bool)
            own[np.asarray(differ, dtype=int) - a] = False
            equal[a - start : a - start + n] |= own
        out.append((start, end - start, int(equal.sum())))
        i += 1
    return out


def _finder(shared: Broadcast, text: str) -> Column:
    names = ("item_id", "start", "n_words", "n_equal", "differ")

    @F.pandas_udf(f"array<struct<{LEAK.replace(' ', ':').replace(',:', ',')}>>")
    def find(texts: pd.Series) -> pd.Series:
        out: list = []
        for _, raw in tk.slices(texts):
            out += shared.value.leaks(*tk.words(raw, tk.MARKS, True))
        return pd.Series([[dict(zip(names, x, strict=True)) for x in row] for row in out], dtype=object)

    return find(text)


def pieces(benchmark: DataFrame) -> DataFrame:
    """item_id, text, n: items, long ones in overlapping pieces of bounded size."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    words = items.select(F.col("item_id").cast("long").alias("item_id"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - LENGTH, F.lit(0)), F.lit(PART))
    return words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, PART + LENGTH - 1))).alias("w")).select(
        "item_id", F.array_join("w", " ").alias("text"), F.size("w").alias("n")
    )


def _rounds(benchmark: DataFrame, once: Callable[[Column], T], each: Callable[[Column], T], text: str = "text") -> list[T]:
    """What `once` makes of the leak column, or what `each` makes of every round's; a round's broadcast ends with it."""
    spark, parts = benchmark.sparkSession, pieces(benchmark)
    rounds = max(1, -(-(parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // ROUND_WORDS))
    out = []
    for r in range(rounds):
        part = parts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r) if rounds > 1 else parts
        shared = spark.sparkContext.broadcast(Index(sorted((x.item_id, x.text) for x in part.collect())))
        if rounds == 1:
            return [once(_finder(shared, text))]
        out.append(each(_finder(shared, text)))
        shared.destroy()
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, n_equal: each stretch of a document that leaked from a benchmark item.

    Words are runs of letters and digits, A to Z lower-cased. Both sides are hashed under fixed masks that leave some
    words out; equal hashes give a diagonal (document place less item place), along which the words around the hit
    are compared. A window of 13 words fits an item if at most 2 of them differ from aligned words of it. A stretch is
    a run of overlapping windows that fit, on any diagonals; n_equal counts its words that equal their counterpart in
    one of these windows. Items of 5 to 12 words count as one window, of which as great a share may differ (1 word from
    7 words on); shorter items only leak where they are a whole document. Rows of one item_id are one item.

    The benchmark side is broadcast in rounds of bounded size, one at a time; the corpus is scanned where it lies,
    without a shuffle if one round is enough. Null or empty texts and null items have no leaks; repeated rows each give
    theirs; an empty table on either side gives an empty result; other columns are not read.
    """
    names = ("doc_id", "item_id", "start", "n_words", "n_equal")
    once = lambda c: docs.select("doc_id", F.explode(c).alias("x")).select("doc_id", *(f"x.{c}" for c in names[1:]))
    rows = keyed(docs, F.col("text").alias("text"))
    each = lambda c: cut(rows.select("id", "h", F.explode(c).alias("x")).select("id", "h", "x.*"))
    found = _rounds(benchmark, once, each)
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.groupBy("id", "h", "item_id").agg(F.collect_set(F.struct("start", "n_words", "differ")).alias("x"))

    @F.pandas_udf("array<struct<start:int,n_words:int,n_equal:int>>")
    def merge(x: pd.Series) -> pd.Series:
        rows = ([(s["start"], s["n_words"], s["differ"]) for s in stretches] for stretches in x)
        return pd.Series([[dict(zip(names[2:], y, strict=True)) for y in merged(r)] for r in rows], dtype=object)

    merged_rows = every.select("id", "h", "item_id", F.explode(merge("x")).alias("x")).select("id", "h", "item_id", "x.*")
    return rows.select("id", "h").join(merged_rows, ["id", "h"]).select(real_id().alias("doc_id"), *names[1:])


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no leak as `find_leaks` defines it."""
    rows = keyed(docs, F.col("text").alias("text"), whole_row(docs).alias("row"))
    found = _rounds(
        benchmark,
        lambda c: docs.filter(F.size(c) == 0),
        lambda c: cut(rows.select("id", "h", F.size(c).alias("n")).filter("n > 0").select("id", "h").distinct()),
    )
    if len(found) == 1:
        return found[0]
    for leaking in found:
        rows = rows.join(leaking, ["id", "h"], "left_anti")
    return rows.select(*row_columns(docs.columns))
