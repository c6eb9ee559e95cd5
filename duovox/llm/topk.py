"""Exact top-k by inner product with the threshold algorithm of Fagin, Lotem and Naor, in blocks of queries and candidates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duovox.llm.common import ready, stash

BLOCK = 2048  # candidates of a block, about
QUERIES = 4096  # queries of a block, about
EXACT = 1 << 53


class SortedLists:
    """A block of integer vectors with one list per dimension, sorted by its component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.peak = int(max(np.abs(vectors.astype(float)).max(initial=0), 1))
        self.floats = self.vectors.astype(np.float64)
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.copy()

    def top(self, own: int, query: np.ndarray, k: int, floor: int | None = None, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best (fewer if there are fewer), ties to the smaller id; vectors with the query's own id are left out.

        Sorted access goes down all lists at once, from the end that suits the sign of the query's component, in growing steps.
        Each vector seen first is scored in full. No unseen vector can score more than the sum of the components reached, so
        the search stops once the kth score is above that sum; an equal score goes on, since ties go by id. With a floor, scores below it
        aren't wanted, and the search stops (at once, where all is below) when the sum is less.
        """
        n = len(self.ids)
        # sums of products are exact in doubles below 2^53; beyond, 64-bit integers
        small = self.peak * float(np.abs(query.astype(float)).max(initial=0)) * len(query) < EXACT
        data, q = (self.floats, query.astype(np.float64)) if small else (self.vectors, query)
        up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        seen = self.ids == own
        best = np.empty(0, np.int64)
        score = np.empty(0, q.dtype)
        at = 0
        while at < n:
            to = min(n, at + step)
            hit = np.zeros(n, bool)
            hit[self.lists[up, at:to].ravel()] = True
            hit[self.lists[down, n - to : n - at].ravel()] = True
            if not len(up) and not len(down):
                hit[:] = True
            if floor is not None:
                most = (data[self.lists[up, at], up] * q[up]).sum() + (data[self.lists[down, n - at - 1], down] * q[down]).sum()
                if most < floor:
                    break
            new = np.flatnonzero(hit & ~seen)
            seen[new] = True
            best, score = np.concatenate([best, new]), np.concatenate([score, data[new] @ q])
            if len(best) > k:
                keep = np.lexsort((best, -score))[:k]
                best, score = best[keep], score[keep]
            if len(best) == k:
                bound = (data[self.lists[up, to - 1], up] * q[up]).sum() + (data[self.lists[down, n - to], down] * q[down]).sum()
                if score.min() > bound:
                    break
            at, step = to, step * 2
        order = np.lexsort((best, -score))
        if floor is not None:
            order = order[score[order] >= floor]
        return self.ids[best[order]], score[order].astype(np.int64)


def whole_vectors(table: DataFrame, scale: int) -> DataFrame:
    """vec_id and v = floor(scale x component) of vectors without null or non-finite components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return table.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def top_k(table: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for each row whose vec_id is divisible by `every`.

    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. Only vectors of the query's length are
    compared. Scores are integer inner products in 64 bits. Repeated rows are candidates each; a repeated query is answered once, by the
    least of its vectors. Other columns are ignored; an empty table gives no rows.

    Every query block meets every candidate block in a task of its own, of bounded size by hashed ids: a block's lists are sorted
    once for all queries that it meets. Queries first meet about sqrt(b) of the b candidate blocks; the kth score there is their floor in
    the others, which give only rows that reach it, about k sqrt(b) in all on average, where each block alone would give k, so k b.
    A window keeps the k best of both.
    """
    spark = ready(table.sparkSession)
    rows = whole_vectors(table, scale)
    n, m = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    block, part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(parts))
    candidates = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.size("v").alias("d"), "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            lists = SortedLists(candidates["vec_id"].to_numpy(np.int64), np.stack(candidates["v"].to_numpy()))
            for own, v, known, floor in zip(queries["own"], queries["v"], queries["known"], queries["floor"]):
                ids, score = lists.top(own, np.asarray(v), k, int(floor) if known else None)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    def met(queries: DataFrame, first: int, last: int) -> DataFrame:
        """The queries' rows in candidate blocks first..last."""
        spread = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")))
        copies = queries.select(spread.alias("block"), part.alias("part"), F.size("v").alias("d"), F.col("vec_id").alias("own"), "v", "known", "floor")
        keys = ["block", "part", "d"]
        mine = candidates.where(F.col("block").between(first, last))
        return copies.groupBy(*keys).cogroup(mine.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda local: local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    head = math.isqrt(blocks - 1) + 1
    plain = asked.select("vec_id", "v", F.lit(False).alias("known"), F.lit(0).cast("long").alias("floor"))
    if head == blocks:
        return best(met(plain, 0, blocks - 1))
    found = stash(best(met(plain, 0, head - 1)))
    floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    again = asked.join(floors, "vec_id", "left").select("vec_id", "v", F.col("floor").isNotNull().alias("known"), F.coalesce("floor", F.lit(0)).alias("floor"))
    return best(found.drop("rank").union(met(again, head, blocks - 1)))


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id != q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
