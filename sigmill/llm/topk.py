"""Exact top-k by inner product with no random access (NRA) over sorted component lists.

The rows are cut into blocks. Each block holds one list per dimension, sorted by component. For a query every list is read
in sequence from both of its ends, next always those ends whose step narrows the range of the unread components most. A
row's bounds are its read components and, for each unread one, the components at the two read positions of its list.
Bounds are worked out row by row: a row's place in each list tells which of its components have been read, and only
those enter a bound.
Reading stops when no row outside a few can still reach the k-th best lower bound; these, at most SPARE times k but for
ties, get their final scores in one pass over the block. Blocks' results are merged by score, ties to the smaller id.
Scores are integers below 2^53, held exactly in doubles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 1024, 4096
SPARE = 4  # rows that may still qualify when reading stops, as a multiple of k
STEPS = 32  # steps in which one end would read a whole list
BLIND, LOOK = 0.6, 2  # bounds are first looked at when this share of the entries is read, and then after so many rounds of steps


class Lists:
    """The sorted lists of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order], dtype=np.float64)
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()  # per dimension, row numbers by component
        self.sorted = np.take_along_axis(self.vectors, self.order.T, axis=0).T.copy()
        self.place = np.empty(self.vectors.shape, np.int16 if len(ids) < 1 << 15 else np.int64)  # of each row in each list
        np.put_along_axis(self.place, self.order.T, np.arange(len(ids), dtype=self.place.dtype)[:, None], axis=0)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, entries read) of the k best rows other than those of id `own`, by score, then id."""
        n = len(self.ids)
        allowed = self.ids != own
        k = min(k, int(allowed.sum()))
        if not k:
            return self.ids[:0], np.zeros(0), 0
        used = np.flatnonzero(query)
        weight, number = query[used], len(used)
        lists, values = np.arange(number), self.sorted[used] if number < len(query) else self.sorted
        can, places, parts = np.arange(n), self.place, self.vectors
        if number < len(query):
            places, parts = np.take(places, used, axis=1), np.take(parts, used, axis=1)
        low, high = np.zeros(number, np.int64), np.full(number, n)  # the unread part of each list
        step, looks = max(8, n // STEPS), 0
        while number and (high > low).any():
            left = high > low
            first, last = values[lists, np.minimum(low, n - 1)] * weight, values[lists, high - 1] * weight
            if (high - low).sum() <= (1 - BLIND) * n * number:
                looks += 1
                if looks % LOOK == 1:
                    unread = (places >= low.astype(places.dtype)) & (places < high.astype(places.dtype))
                    ends = np.where(left, [np.maximum(first, last), np.minimum(first, last)], 0.0)
                    bounds = (parts * ~unread) @ weight + (unread @ ends.T).T
                    bounds[:, ~allowed[can]] = -np.inf
                    bar = np.partition(bounds[1], len(can) - k)[len(can) - k]
                    keep = np.flatnonzero(bounds[0] >= bar)
                    can, places, parts = can[keep], places[keep], parts[keep]
                    if len(can) <= SPARE * k:
                        break
            taken = np.minimum(step, high - low)
            gain = np.concatenate([np.abs(values[lists, np.minimum(low + taken, n - 1)] * weight - first), np.abs(values[lists, np.maximum(high - 1 - taken, 0)] * weight - last)])
            gain[np.concatenate([~left, ~left])] = -1.0
            chosen = np.argsort(-gain, kind="stable")[:number]
            chosen = chosen[gain[chosen] >= 0]
            heads, tails = chosen[chosen < number], chosen[chosen >= number] - number
            low[heads] = np.minimum(low[heads] + step, high[heads])
            high[tails] = np.maximum(high[tails] - step, low[tails])
        can = can[allowed[can]]
        final = self.vectors[can] @ query  # `can` is in the order of the rows: one pass over the block
        best = np.lexsort((self.ids[can], -final))[:k]
        return self.ids[can][best], final[best], int(n * number - (high - low).sum())


def whole(vector: np.ndarray | None, scale: int) -> np.ndarray | None:
    """floor(scale * x) of each component as a double."""
    return None if vector is None else np.floor(scale * np.asarray(vector, dtype=np.float64))


def top_k(queries: DataFrame, rows: DataFrame, k: int, scale: int = 1024, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of other ids with the highest inner product.

    queries, rows: (vec_id long, embedding array of numbers). Vectors that are null, or hold null or non-finite
    components, take no part. A vector shorter than another counts as continued by zeros. Repeated equal rows count
    once; different vectors of one id are different rows. A query id with several vectors asks with the smallest.
    Queries and rows meet in blocks of bounded size, each pair of blocks in one task.
    """
    good = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    ).distinct()
    queries, rows = good(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), good(rows)
    n_rows, n_queries = rows.count(), queries.count()
    row_parts, query_parts = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    part = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = queries.withColumn("qb", part(query_parts)).withColumn("rb", others(row_parts))
    right = rows.withColumn("rb", part(row_parts)).withColumn("qb", others(query_parts))

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(r):
            dims = max([len(x) for x in q["embedding"]] + [len(x) for x in r["embedding"]])
            dense = lambda col: np.stack([np.pad(whole(x, scale), (0, dims - len(x))) for x in col])
            lists = Lists(r["vec_id"].to_numpy(np.int64), dense(r["embedding"]))
            for own, vector in zip(q["vec_id"].to_numpy(np.int64), dense(q["embedding"])):
                ids, scores, _ = lists.top(own, vector, k)
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.astype(np.int64).tolist()
        return pd.DataFrame(out)

    tasks = min(row_parts * query_parts, 1 << 14)
    left, right = left.repartition(tasks, "qb", "rb"), right.repartition(tasks, "qb", "rb")  # else small blocks would share a task
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(search, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
