"""Substring dedup: relative Lempel-Ziv parsing of every document against content-chosen reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import textkit as tk
from cairn.llm.common import Scratch, cut, keyed, real_id

#: Words of a window, and words of the anchor that cuts reference blocks.
WINDOW, ANCHOR = 35, 8
LOW, CHUNK = (1 << 24) - 1, 1 << 23


def anchors(g: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each `span` neighbouring hashes stands, the first of equal ones."""
    out = []
    for at in range(0, max(len(g) - span + 1, 0), CHUNK):  # places fit the low bits within a chunk
        part = g[at : at + CHUNK + span - 1]
        least = tk.window_min((part & ~tk.U(LOW)) | np.arange(len(part), dtype=tk.U), span)
        out.append(at + (least & tk.U(LOW)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def blocks_of(w: np.ndarray, bounds: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Reference blocks of the texts whose words are w: text number, first window, number of windows, anchor and content.

    Every window of words has an anchor, the least hash of `anchor` words in it (the first of equal ones). Neighbouring
    windows with the same anchor form a block; its content is all words of its windows. A block has at most
    window - anchor + 1 windows, so its first and its last window hold all of its words.
    """
    g = tk.grams(w, anchor)
    place = anchors(g, window - anchor + 1)
    i = np.arange(len(place))
    text = np.searchsorted(bounds, i, "right") - 1
    good = i + window <= bounds[text + 1]
    i, place, text = i[good], place[good], text[good]
    if not len(i):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (i[1:] != i[:-1] + 1))))
    a, count = i[new], np.diff(np.concatenate((new, [len(i)])))
    whole = tk.grams(w, window, 1)
    content = tk._mix(tk._mix(whole[a] * tk.GOLD + whole[a + count - 1]) + (count * window + place[new] - a).astype(tk.U))
    return text[new], a - bounds[text[new]], count, g[place[new]].view(np.int64), content.view(np.int64)


def parse(a: np.ndarray, n: np.ndarray, again: np.ndarray, asked: np.ndarray, ref: np.ndarray, shift: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (first word, end) of a document, and the windows at their boundaries that are still to be checked.

    Of each block: first window, windows, whether it stands elsewhere too, whether its windows are to be checked,
    the reference document, and how far the place there is shifted. Greedy: from a block that stands elsewhere too, a
    factor goes on as long as the next block stands at the next place of the same reference document. Blocks with a
    known anchor whose whole content stands nowhere else hold the boundaries; they are checked, and so is the first of
    each kind of block they may partly agree with.
    """
    order = np.argsort(a)
    check = order[asked[order]]
    count = n[check]
    checks = np.repeat(a[check] - np.cumsum(count) + count, count) + np.arange(count.sum())
    x = order[again[order]]
    if not len(x):
        return np.empty((0, 2), dtype=np.int64), checks
    on = (a[x][1:] == (a + n)[x][:-1]) & (ref[x][1:] == ref[x][:-1]) & (shift[x][1:] == shift[x][:-1])
    first = np.flatnonzero(np.concatenate(([True], ~on)))
    last = np.concatenate((first[1:], [len(x)])) - 1
    factors = np.stack((a[x[first]], (a + n)[x[last]] + window - 1), axis=1)
    return factors[factors[:, 1] - factors[:, 0] >= window], checks


def _finish(raw: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    """Words, words removed, and the hash of what is left."""
    own = raw.split()  # bytes.split() cuts at 0x20 and 0x09 to 0x0D
    if not len(spans):
        return len(own), 0, hashlib.sha256(b" ".join(own)).hexdigest()
    edge = np.zeros(len(own) + 1, dtype=np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = b" ".join([x for x, k in zip(own, keep.tolist(), strict=True) if k])
    return len(own), int(len(own) - keep.sum()), hashlib.sha256(kept).hexdigest()


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256: each word goes that lies in a window of words found elsewhere too.

    1. Every document is cut into reference blocks at places that its content alone chooses, so equal windows lie in
       blocks with equal anchors wherever they stand. All blocks of all documents are the reference.
    2. The index gives each distinct block that has an anchor in common with others its first place (document, window)
       and count.
    3. Each document is parsed greedily into factors: runs of blocks that continue at one reference document.
       Factors of `window` words or more are duplicate spans.
    4. At factor boundaries, where a block has a known anchor but ends differently, windows are checked one by one.

    Windows are judged on the input; all occurrences of a repeated window go, overlapping ones in one document too.
    Comparison is by hashes: 64 bits of a block's content besides 64 of its anchor, 128 of a window. Null texts count as
    empty (no words, hash of nothing); texts shorter than a window lose nothing; equal rows are two documents and remove
    each other's windows. An empty table gives an empty result. Columns other than doc_id and text are not read.

    A frequent block is only counted (combined before the shuffle) and joined, where Spark splits hot keys. A
    document's factors are gathered as sets, so rows equal in doc_id and text share them.
    """
    with Scratch(docs.sparkSession) as scratch:
        return cut(_dedup(docs, window, anchor, scratch))


def _dedup(docs: DataFrame, window: int, anchor: int, scratch: Scratch) -> DataFrame:
    docs = keyed(docs, F.coalesce("text", F.lit("")).alias("text"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, raw in tk.slices(pdf["text"]):
                text, a, n, g, content = blocks_of(*tk.words(raw, tk.SPACES, False), window, anchor)
                at = pdf.iloc[first + text]
                yield pd.DataFrame({"id": at["id"].array, "h": at["h"].array, "a": a, "n": n, "g": g, "content": content})

    blocks = scratch.write(docs.mapInPandas(cut_up, "id long, h long, a int, n int, g long, content long"))
    known = cut(blocks.groupBy("g").count().filter("count > 1").select("g"))
    shared = scratch.write(blocks.join(known, "g"))
    index = cut(shared.groupBy("g", "content").agg((F.count("*") > 1).alias("again"), F.min(F.struct("id", "h", "a")).alias("ref")))
    # anchors with a block that must be checked: their reference blocks give their windows to be checked against
    asked = index.filter("NOT again").groupBy("g").agg(F.lit(True).alias("asked"))
    index = index.join(asked, "g", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    block = F.struct(
        "a", "n", "again", (F.col("asked") & (~F.col("again") | (F.col("ref") == F.struct("id", "h", "a")))).alias("asked"),
        F.xxhash64("ref.id", "ref.h").alias("ref"), (F.col("ref.a") - F.col("a")).alias("shift"),
    )
    factors = shared.join(index, ["g", "content"]).groupBy("id", "h").agg(F.collect_set(block).alias("b"))
    parts = ("a", "n", "again", "asked", "ref", "shift")
    factors = factors.select("id", "h", *(F.col("b").getField(c).alias(c) for c in parts))
    types = (np.int64, np.int64, bool, bool, np.int64, np.int64)
    out = "id long, h long, n_words long, n_removed long, kept_sha256 string"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Finishes documents without windows to check; gives the text, spans and those windows' hashes of the others."""
        for pdf in batches:
            rows = []
            for doc, h, text, *own in zip(*(pdf[c] for c in ("id", "h", "text", *parts)), strict=True):
                raw = text.encode()
                spans, checks = ((), ()) if own[0] is None else parse(*(np.asarray(x, dtype=t) for x, t in zip(own, types, strict=True)), window)
                if len(checks):
                    w, _ = tk.words([raw], tk.SPACES, False)
                    lanes = (tk.grams(w, window, lane)[checks].view(np.int64) for lane in (0, 1))
                    rows.append((doc, h, None, None, None, text, spans.ravel(), checks, *lanes))
                else:
                    rows.append((doc, h, *_finish(raw, spans), None, None, None, None, None))
            names = ["id", "h", "n_words", "n_removed", "kept_sha256", "text", "spans", "at", "x", "y"]
            yield pd.DataFrame(rows, columns=names).astype({"n_words": "Int64", "n_removed": "Int64"})

    compared = scratch.write(
        docs.join(factors, ["id", "h"], "left").select("id", "h", "text", *parts)
        .mapInPandas(compare, out + ", text string, spans array<int>, at array<int>, x array<long>, y array<long>")
    )
    unsettled = compared.filter("text IS NOT NULL")
    spots = unsettled.select("id", "h", F.explode(F.arrays_zip("at", "x", "y")).alias("z")).select("id", "h", "z.*")
    again = cut(spots.groupBy("x", "y").count().filter("count > 1").select("x", "y"))
    found = spots.join(again, ["x", "y"]).groupBy("id", "h").agg(F.collect_set("at").alias("more"))
    late = unsettled.join(found, ["id", "h"], "left")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, h, text, spans, more in zip(pdf["id"], pdf["h"], pdf["text"], pdf["spans"], pdf["more"], strict=True):
                own = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
                if more is not None:
                    at = np.asarray(more, dtype=np.int64)
                    own = np.concatenate((own, np.stack((at, at + window), axis=1)))
                rows.append((doc, h, *_finish(text.encode(), own)))
            yield pd.DataFrame(rows, columns=["id", "h", "n_words", "n_removed", "kept_sha256"])

    done = compared.filter("text IS NULL").select("id", "h", "n_words", "n_removed", "kept_sha256")
    done = done.unionByName(late.select("id", "h", "text", "spans", "more").mapInPandas(settle, out))
    return done.select(real_id().alias("doc_id"), "n_words", "n_removed", "kept_sha256")
