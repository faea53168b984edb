"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt at random into blocks of bounded size and queries into blocks of their own; a
cell is one block of each.  In a cell every dimension has a list of candidates sorted by value.  A
query reads all lists in step, from the end its own component favours, scores what it meets, and
stops when no unread candidate can reach its kth score.  The cells' results are merged per query.

The bound is the largest product of the query with a vector that stays under every list's last value and
is no longer than the block's longest vector, which is tighter than the lists' values alone.  It stops early
where vectors lean to a few directions; where they spread evenly over many, as in the driver's table, some list
holds every candidate before any bound falls below the kth score, whatever the bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "query_id long, vec_id long, score long"
#: Products of this size and below are exact in double precision.
EXACT = 2**53


class Lists:
    """One block's candidates with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        at = np.argsort(ids, kind="stable")  # equal scores then stand in order of id
        self.ids, self.values = ids[at], values[at]
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)
        self.longest = float(np.sqrt((self.values.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        self.read = 0  # candidates scored so far, all queries together

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, own id left out; equal scores go to smaller ids."""
        n = len(self.ids)
        up, down = np.nonzero(query > 0)[0], np.nonzero(query < 0)[0]
        unread = np.ones(n, dtype=bool)
        best, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.values.dtype)
        low, high = 0, min(16, n)
        while True:
            met = np.concatenate([self.order[n - high : n - low, up].ravel(), self.order[low:high, down].ravel()])
            new = np.unique(met[unread[met]]) if len(met) else np.nonzero(unread)[0]
            unread[new] = False
            self.read += len(new)
            new = new[self.ids[new] != own]
            best, scores = np.concatenate([best, new]), np.concatenate([scores, self.values[new] @ query])
            keep = np.lexsort((best, -scores))[:k]
            best, scores = best[keep], scores[keep]
            if high == n or not len(met):
                break
            if len(best) == k and scores[-1] > self.bound(query, high):  # an equal score could still have a smaller id
                break
            low, high = high, min(high + max(16, high // 4), n)
        return self.ids[best], scores


    def bound(self, query: np.ndarray, depth: int) -> float:
        """The most an unread candidate can score after ``depth`` rows of every list.

        Along the query's signs no unread component exceeds its list's last value.  The longest vector under those
        limits follows the query as far as its length allows: components are min(limit, f * weight) for the one f
        that uses the length up.  Sorted by limit over weight, f lies where the length is reached.
        """
        n = len(self.ids)
        weight = np.abs(query).astype(np.float64)
        limit = np.where(query > 0, self.sorted[n - depth], -self.sorted[depth - 1]).astype(np.float64)
        weight, limit = weight[weight > 0], limit[weight > 0]
        plain = float(weight @ limit)
        if (limit <= 0).any():
            return plain
        at = np.argsort(limit / weight)
        weight, limit = weight[at], limit[at]
        full = np.concatenate([[0.0], np.cumsum(limit**2)])[:-1]  # length used by components at their limit
        free = np.cumsum((weight**2)[::-1])[::-1]
        f = limit / weight
        reached = np.nonzero(full + f**2 * free >= self.longest**2)[0]
        if not len(reached):
            return plain
        k = int(reached[0])
        f = np.sqrt(max(self.longest**2 - full[k], 0.0) / free[k])
        return min(plain, float(weight[:k] @ limit[:k] + f * free[k]) * (1 + 1e-9))


def usable(vector: Column) -> Column:
    """Not null, and all components present and finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(good(x.cast("double")), F.lit(False))), F.lit(False))


def quantised(vector: Column, scale: float = 256.0) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """The ``k`` best rows of ``vectors(vec_id, embedding, ...)`` for each row that ``is_query`` holds for.

    Components become floor(scale * x); scores are integer inner products.  Returns query_id, rank
    (from 1), vec_id and score; equal scores go to the smaller vec_id; a query with fewer than ``k``
    other rows gets them all.

    Rows whose vec_id or vector is null, or whose vector holds a null or non-finite component, take no
    part.  vec_id names a row: rows that share it are not each other's results.  Vectors are compared
    with those of their own length.  Scores that 64 bits could not hold are an error, not a wrong number.  An empty table gives no rows.  Other columns are not read.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    every, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-every // block)), max(1, -(-asking // query_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    given = rows.select("vec_id", "v", F.lit(False).alias("asks"), deal(blocks, 1).alias("b"), spread(query_blocks).alias("q"))
    asked = rows.filter("asks").select("vec_id", "v", "asks", spread(blocks).alias("b"), deal(query_blocks, 2).alias("q"))
    cells = given.unionByName(asked).withColumn("d", F.size("v"))

    def run(cell):
        import pyarrow as pa

        ids = cell.column("vec_id").to_numpy()
        d = cell.column("d")[0].as_py()
        v = cell.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
        top = max(int(v.max(initial=0)), -int(v.min(initial=0)))
        if top * top * max(1, d) >= 2**63:
            raise ValueError(f"scores of components up to {top} exceed 64 bits; take a smaller scale")
        if top * top * max(1, d) <= EXACT:
            v = v.astype(np.float64)
        asks = cell.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        lists = Lists(ids[~asks], v[~asks])
        out = [(np.full(0, 0, dtype=np.int64),) * 3]
        for own, query in zip(ids[asks].tolist(), v[asks]):
            best, scores = lists.top(query, own, k)
            out.append((np.full(len(best), own, dtype=np.int64), best, scores.astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    found = cells.groupBy("b", "q", "d").applyInArrow(run, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
