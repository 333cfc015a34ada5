"""Line dedup: winnowed line hashes, joined and extended both ways, find repeated runs of lines; later runs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, cut, keyed, row_columns, whole_row

#: Lines hashed together, and how many neighbouring hashes choose one fingerprint. Every repeated run of
#: K + WINDOW - 1 lines or more is found.
K, WINDOW = 2, 4
#: Characters from which a single repeated line goes.
ALONE = 60


def _lanes(*x: Column) -> tuple[Column, Column]:
    """128 bits of hash in two columns."""
    return F.xxhash64(*x).alias("c1"), F.xxhash64(F.lit(1), *x).alias("c2")


def _spots(docs: DataFrame, k: int, window: int, alone: int | None) -> DataFrame:
    """One row for each line (c1, c2: its hash; counts: goes if it stood before) and for each fingerprint.

    A fingerprint at line i has the hash f of k lines and the hashes of up to window - 1 lines on each side.
    """
    side = window - 1
    parts = F.split("text", "\n")
    at = keyed(docs.filter(F.col("text").isNotNull()), parts.alias("l"), F.transform(parts, lambda x: F.xxhash64(x)).alias("hl"))
    n = F.size("hl")
    grams = F.when(n >= k + side, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("hl", i, k))))
    at = at.withColumn("kg", grams)
    # the first least hash of each window of neighbouring hashes
    least = lambda i: i + F.array_position(F.slice("kg", i, window), F.array_min(F.slice("kg", i, window))).cast("int") - 2
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k - side + 1, F.lit(1))), least))
    at = at.withColumn("places", F.when(F.col("kg").isNotNull(), places))
    none, nothing = F.lit(None).cast("long"), F.lit(None).cast("array<long>")
    seeds = F.transform(
        F.coalesce("places", F.array().cast("array<int>")),
        lambda p: F.struct(
            p.alias("i"), none.alias("c1"), none.alias("c2"), F.lit(False).alias("counts"),
            F.element_at("kg", p + 1).alias("f"),
            F.slice("hl", F.greatest(p - side, F.lit(0)) + 1, F.least(p, F.lit(side))).alias("left"),
            F.slice("hl", p + k + 1, side).alias("right"),
        ),
    )
    spots = seeds
    if alone is not None:
        lines = F.transform(
            "l",
            lambda x, i: F.struct(
                i.cast("int").alias("i"), *_lanes(x), ((n == 1) | (F.length(x) >= alone)).alias("counts"),
                none.alias("f"), nothing.alias("left"), nothing.alias("right"),
            ),
        )
        spots = F.concat(lines, seeds)
    return at.select("id", "h", F.inline(spots))


def _alike(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    differ = F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b)) + 1), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)) | (i > F.least(F.size(a), F.size(b))))
    return F.array_min(differ).cast("int") - 1


def repeated_lines(docs: DataFrame, k: int = K, window: int = WINDOW, alone: int | None = ALONE) -> DataFrame:
    """(id, h, gone), keyed as `keyed` does: sorted places of lines that are a later repeat. See `dedup_lines`."""
    with Scratch(docs.sparkSession) as scratch:
        return cut(_repeats(scratch.write(_spots(docs, k, window, alone)), k, window, alone is not None))


def _repeats(spots: DataFrame, k: int, window: int, singles: bool) -> DataFrame:
    run = k + window - 1
    # null ids, which the lowest bit of h marks, come first
    place = lambda i: F.struct((-F.col("h").bitwiseAND(F.lit(1))).alias("none"), "id", "h", F.col(i).alias("i"))

    # fingerprints join the first place of the same hash, and the match is extended line by line both ways
    seeds = spots.filter("f IS NOT NULL").select("id", "h", "f", "i", "left", "right", place("i").alias("place"))
    first = seeds.groupBy("f").agg(F.min(F.struct("place", "left", "right")).alias("a"), F.max("place").alias("last"))
    first = first.filter("a.place <> last").select("f", "a")
    joined = seeds.join(first, "f").filter("place <> a.place")
    joined = joined.withColumn("l", _alike(F.reverse("left"), F.reverse(F.col("a")["left"]))).withColumn("r", _alike(F.col("right"), F.col("a")["right"]))
    joined = cut(joined.drop("a"))
    matched = joined.filter(F.col("l") + k + F.col("r") >= run).select(
        "id", "h", (F.col("i") - F.col("l")).alias("start"), (F.col("l") + k + F.col("r")).alias("n")
    )
    # where the match stops short of the lines around, a run may agree with another place instead
    opens = joined.filter("l < size(left) OR r < size(right)")
    lo, hi = F.size("left") - F.col("l"), F.size("left") + k + F.col("r")  # of the match, from the first line of `left`
    starts = F.filter(
        F.sequence(F.lit(0), F.size("left") + F.size("right") + F.lit(k - run)),
        lambda s: (s <= F.size("left")) & (s + run >= F.size("left") + k) & ~((s >= lo) & (s + run <= hi)),
    )
    opens = opens.filter(F.size("left") + F.size("right") + k >= run).select(
        "id", "h", "f", "left", "right", (F.col("i") - F.size("left")).alias("base"), F.explode(starts).alias("s")
    )
    before, after = F.expr("slice(left, s + 1, size(left))"), F.slice("right", F.lit(1), F.col("s") + run - F.size("left") - k)
    windows = opens.select("id", "h", (F.col("base") + F.col("s")).alias("start"), *_lanes(F.col("f"), F.size("left") - F.col("s"), before, after))
    earliest = windows.groupBy("c1", "c2").agg(F.min(place("start")).alias("a"), F.max(place("start")).alias("b")).filter("a <> b")
    later = windows.join(earliest.select("c1", "c2", "a"), ["c1", "c2"]).filter(place("start") != F.col("a"))
    gone = matched.unionByName(later.select("id", "h", "start", F.lit(run).alias("n")))

    if singles:
        lines = spots.filter("f IS NULL").select("id", "h", "i", "c1", "c2", "counts")
        first = lines.groupBy("c1", "c2").agg(F.min(place("i")).alias("a"), F.max(place("i")).alias("b"), F.max("counts").alias("any"))
        again = lines.filter("counts").join(first.filter("a <> b AND any").select("c1", "c2", "a"), ["c1", "c2"]).filter(place("i") != F.col("a"))
        gone = gone.unionByName(again.select("id", "h", F.col("i").alias("start"), F.lit(1).alias("n")))
    # sets, so that rows equal in id and text add nothing
    gone = gone.groupBy("id", "h").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    lines = F.flatten(F.transform("runs", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    return gone.select("id", "h", F.array_sort(F.array_distinct(lines)).alias("gone"))


def _deduped(docs: DataFrame, k: int, window: int, alone: int | None) -> DataFrame:
    """row (of `whole_row`), text, n_lines, n_removed."""
    rows = keyed(docs, F.col("text").alias("text"), whole_row(docs).alias("row"))
    joined = rows.join(repeated_lines(docs, k, window, alone), ["id", "h"], "left").select("row", "text", "gone")
    lines, m = F.split("text", "\n"), F.size("gone")
    joined = joined.withColumn("n", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
    # the lines between neighbouring ones that go
    begin = lambda j: F.when(j == 0, 0).otherwise(F.element_at("gone", F.greatest(j, F.lit(1))) + 1)
    end = lambda j: F.when(j == m, F.col("n")).otherwise(F.element_at("gone", F.least(j + 1, m)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), m), lambda j: F.slice(lines, begin(j) + 1, F.greatest(end(j) - begin(j), F.lit(0)))))
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.col("n").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(m).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, k: int = K, window: int = WINDOW, alone: int | None = ALONE) -> DataFrame:
    """The documents with their columns, `text` without repeated runs, plus n_lines and n_removed.

    Lines are parts of the text between newlines, taken as they are. A run of k + window - 1 or more lines that
    began before (smaller doc_id, null first, then text hash, then position) is deleted; its first place stays.
    With `alone`, a single line that stood before goes too if it has so many characters or is the whole document.

    1. Of every `window` neighbouring hashes of k lines the least is a fingerprint (winnowing).
    2. A fingerprint joins the first place that shows it, and the match is extended line by line both ways.
    3. Where that match ends before the lines around the fingerprint do, the runs left over are compared with those
       of all other places of the fingerprint.

    Null texts stay null with 0 lines; the empty text is one empty line. Rows equal in doc_id and text are one
    document and keep or lose the same lines. An empty table gives an empty result. A document may end up empty but
    stays. Columns of any other name pass through; own columns named n_lines or n_removed (in any case) are replaced
    here, `without_repeated_lines` keeps them.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    docs = docs.select(*(f"`{c.replace('`', '``')}`" for c in keep))
    return _deduped(docs, k, window, alone).select(*row_columns(keep, text=F.col("text")), "n_lines", "n_removed")


def without_repeated_lines(docs: DataFrame, k: int = K, window: int = WINDOW, alone: int | None = ALONE) -> DataFrame:
    """The documents with exactly their columns: `text` as `dedup_lines` leaves it; n_chars, if there, follows changed texts."""
    out = _deduped(docs, k, window, alone)
    instead = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        had = F.col("row").getField(f"c{docs.columns.index('n_chars')}")
        instead["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(had)
    return out.select(*row_columns(docs.columns, **instead))


def dedup_sql(alone: int = ALONE, run: int = K + WINDOW - 1) -> str:
    """The same by brute force, for tables whose doc_id is unique."""
    ahead = " || chr(10) || ".join(f"lead(line, {j}) OVER w" for j in range(run))
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
c AS (
  SELECT doc_id, i, line, {ahead} AS content, count(*) OVER (PARTITION BY doc_id) AS n
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT doc_id, i, line, content IS NOT NULL AND row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1 AS again,
         row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AND (n = 1 OR length(line) >= {alone}) AS lone
  FROM c),
k AS (
  SELECT doc_id, i, line,
         lone OR coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {run - 1} PRECEDING AND CURRENT ROW), false) AS gone
  FROM r),
a AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
  FROM k GROUP BY doc_id)
SELECT d.doc_id, a.text, coalesce(a.n_lines, 0)::BIGINT AS n_lines, coalesce(a.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN a USING (doc_id)"""
