"""Exact top-k search by inner product: best-first search in an M-tree of paged metric nodes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.common import cut

#: Vectors of a cell, about; cells at most (their centres are a sample of that size); entries of a leaf.
CELL, CELLS, LEAF = 512, 1024, 64
#: Vectors of a page, about: at least, and at most; in between there are PAGES pages.
PAGE, PAGE_MOST, PAGES = 1024, 16_384, 4096
#: Queries that one task asks of a page, about; a page that more queries reach is searched by several tasks.
ASKED = 4096
FACTOR = 1024


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance; ties to the first."""
    square = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    at = square.argmin(1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(1))


class Page:
    """Leaves of a page below its cell's centre, with radii and stored distances to parents."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.centre = centre
        # evenly spaced members as routing objects; equal ones would only make empty leaves
        self.routes = np.unique(x[np.linspace(0, len(x) - 1, max(1, len(x) // LEAF)).astype(int)], axis=0)
        leaf, distance = _nearest(x, self.routes)
        order = np.lexsort((distance, leaf))
        self.ids, self.x, self.to_route = ids[order], x[order], distance[order]
        self.bounds = np.searchsorted(leaf[order], np.arange(len(self.routes) + 1))
        full = self.bounds[1:] > self.bounds[:-1]
        self.radius = np.zeros(len(self.routes))
        self.radius[full] = np.maximum.reduceat(self.to_route, self.bounds[:-1][full])
        self.to_parent = np.sqrt(((self.routes - centre) ** 2).sum(1))

    def search(self, q: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """(score, id) of the k best members other than the query's own that score `least` or more.

        For any x in a ball around c of radius r, q.x <= q.c + |q| r. A leaf is first bounded through its stored
        distance to the centre, then through its own routing object; entries through their stored distances.
        """
        norm, parent = float(np.sqrt(q @ q)) * (1 + 1e-9), float(q @ self.centre)
        bound = parent + norm * (self.to_parent + self.radius)
        queue = [(-b, i, False) for i, b in enumerate(bound.tolist()) if b + 1e-6 >= least]
        heapq.heapify(queue)
        best: list[tuple[float, int]] = []  # heap of (score, -id)
        while queue and -queue[0][0] + 1e-6 >= least:
            _, i, near = heapq.heappop(queue)
            if not near:
                at = float(q @ self.routes[i])
                if at + norm * self.radius[i] + 1e-6 >= least:
                    heapq.heappush(queue, (-(at + norm * self.radius[i]), i, True))
                continue
            a, b = self.bounds[i], self.bounds[i + 1]
            # entries stand by distance to the route: those far enough to matter are at the end
            at = float(q @ self.routes[i])
            a += int(np.searchsorted(self.to_route[a:b], (least - at) / norm - 1e-6)) if norm and least > -np.inf else 0
            scores = self.x[a:b] @ q
            for j in np.flatnonzero(scores >= least).tolist():
                if self.ids[a + j] != own:
                    entry = (float(scores[j]), -int(self.ids[a + j]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k:
                least = max(least, best[0][0])
        return [(int(s), -i) for s, i in best]


def _usable(v: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, finite), F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k vectors with the largest integer inner product.

    Components become floor(1024 * x). Both frames have vec_id and embedding; a query's own vec_id is no candidate of
    it; ties go to the smaller vec_id. The answer is exact.

    The tree's root has up to CELLS cells around sampled centres, with covering radii; cells are cut into pages by a
    hash of the id, so that one very common vector fills many pages; a page holds leaves of about LEAF entries. Every
    query first searches one page of its most promising cell, which gives a least score to reach; then only cells
    whose bound reaches it are searched, best leaf first. A task searches one page for about ASKED of the queries that
    reach it.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids. Shorter vectors count
    as if filled up with zeros. Of repeated query ids one (the least vector) is asked; repeated candidate rows each
    count. An empty table, or one with no usable vector, gives an empty result. Other columns are not read. Scores
    must stay below 2**53.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * FACTOR).cast("long"))
    usable = lambda df: df.filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), whole.alias("v"))
    x = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, width = x.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    cells = max(1, min(CELLS, n // CELL))
    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(cells).collect()
    centres = np.unique(_matrix([r["v"] for r in sample], width), axis=0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, distance = _nearest(_matrix(pdf["v"].tolist(), width), centres)
            yield pdf.assign(cell=cell, distance=distance)

    placed = cut(x.mapInPandas(assign, "vec_id long, v array<long>, cell int, distance double"))
    size = min(PAGE_MOST, max(PAGE, -(-n // PAGES)))
    found = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.ceil(F.count("*") / size).cast("int").alias("pages")).collect()
    radius, pages = np.full(len(centres), -np.inf), np.zeros(len(centres), dtype=int)
    for r in found:  # CELLS rows at most
        radius[r["cell"]], pages[r["cell"]] = r["radius"], r["pages"]
    members = placed.withColumn("page", F.pmod(F.xxhash64("vec_id"), F.element_at(F.lit(pages.tolist()), F.col("cell") + 1)).cast("int"))

    def bound(q: np.ndarray) -> np.ndarray:
        return q @ centres.T + np.sqrt((q * q).sum(1))[:, None] * radius[None, :] * (1 + 1e-9) + 1e-6

    def visit_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = _matrix(pdf["v"].tolist(), width)
            cell = np.where(pages > 0, q @ centres.T, -np.inf).argmax(1)
            yield pdf.assign(cell=cell, page=pdf["vec_id"].to_numpy() % pages[cell], least=-np.inf)

    def visit_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q, least = _matrix(pdf["v"].tolist(), width), pdf["least"].fillna(-np.inf).to_numpy()
            row, cell = np.nonzero((bound(q) >= least[:, None]) & (pages > 0)[None, :])
            each = pages[cell]
            row, cell = np.repeat(row, each), np.repeat(cell, each)
            page = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            for a in range(0, len(row), 4096):
                part = pdf.iloc[row[a : a + 4096]][["vec_id", "v"]]
                yield part.assign(cell=cell[a : a + 4096], page=page[a : a + 4096], least=least[row[a : a + 4096]])

    def search(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(ask):
            page = Page(own["vec_id"].to_numpy(), _matrix(own["v"].tolist(), width), centres[own["cell"].iloc[0]])
            for i, v, least in zip(ask["vec_id"], ask["v"], ask["least"], strict=True):
                rows += [(i, y, s) for s, y in page.search(_matrix([v], width)[0], i, k, least)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    def searched(visits: DataFrame) -> DataFrame:
        # pages that no query reaches are left out; one that very many reach is copied for each ASKED of them
        at = ["cell", "page"]
        load = visits.groupBy(*at).agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
        own = members.join(load, at).select("vec_id", "v", *at, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        ask = visits.join(load, at).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
        keys = (*at, "part")
        pair = own.groupBy(*keys).cogroup(ask.groupBy(*keys))
        return pair.applyInPandas(search, "query_id long, vec_id long, score long")

    visit = "vec_id long, v array<long>, cell int, page int, least double"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = searched(asked.mapInPandas(visit_first, visit)).groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s"))
    least = cut(one.select(F.col("query_id").alias("vec_id"), F.when(F.col("c") >= k, F.col("s").cast("double")).alias("least")))
    rest = asked.join(least, "vec_id", "left").select("vec_id", "v", "least").mapInPandas(visit_rest, visit)
    ranked = searched(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_sql(step: int = 100, k: int = 10) -> str:
    return f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({FACTOR} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
  FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % {step} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
