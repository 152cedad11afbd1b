"""Exact top-k search over integer vectors by MaxScore (Turtle and Flood 1995), over impact-ordered postings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, EVERY, SCALE = 5, 50, 256
#: Rows of a shard and of a block of queries; both bound what a task holds.
SHARD_ROWS, QUERY_ROWS, LEAST_SHARDS = 16_384, 4_096, 16
#: Terms between two looks at which candidates are still competitive, and terms whose first postings give a first threshold.
STRIDE, SEEDS = 8, 4


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): floor(256 * x) of each component; vectors null or with null or non-finite parts are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(F.col("x"), lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), x.alias("x")).where(~bad)
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))


class Postings:
    """A shard's rows under every dimension, in order of value, so that a term's highest impacts are at one end of its list.

    A query's terms are its dimensions. A row's impact from a term is what it adds over the least that any row of the
    shard gets from it; the term's bound is the largest impact.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, largest: int) -> None:
        """Rows sorted by id; largest: the largest absolute component of any query."""
        # Doubles hold whole numbers exactly up to 2**53, and multiply faster.
        kind = float if rows.shape[1] * float(np.abs(rows).max()) * float(max(1, largest)) < 2**52 else np.int64
        self.ids, self.kind = ids, kind
        self.columns = np.ascontiguousarray(rows.T.astype(kind))
        self.order = np.argsort(self.columns, axis=1, kind="stable")
        self.values = np.take_along_axis(self.columns, self.order, axis=1)
        self.low, self.high = self.values[:, 0], self.values[:, -1]

    def _top(self, term: int, weight: float, least: float) -> np.ndarray:
        """Rows with an impact of at least `least` under a term: one end of its postings."""
        if weight > 0:
            return self.order[term, np.searchsorted(self.values[term], np.floor(self.low[term] + least / weight - 1e-6), side="left") :]
        return self.order[term, : np.searchsorted(self.values[term], np.ceil(self.high[term] + least / weight + 1e-6), side="right")]

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, postings read) of the k best rows but `own`, ties to the smaller id.

        1. The first postings of the strongest terms, scored in full, give a threshold under the k-th best score. 2. The
        weakest terms, as long as their bounds together stay under what a row needs to reach it, are non-essential: no row
        gets there by them alone. 3. The others are essential and their postings are read from the highest impact on, down
        to a share of the slack that the non-essential ones leave; a row in none of these stretches cannot get there either.
        4. What was read is probed term by term, strongest first, and dropped as soon as the bounds of the terms left
        cannot lift it to the threshold, which rises with the best rows so far.
        """
        q = query.astype(self.kind)
        base = np.minimum(q * self.low, q * self.high)
        bound = np.maximum(q * self.low, q * self.high) - base
        terms = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])
        floor = base.sum()
        seeds = [self.order[t, -2 * k - 1 :] if q[t] > 0 else self.order[t, : 2 * k + 1] for t in terms[:SEEDS].tolist()]
        seeds = np.unique(np.concatenate([*seeds, self.order[0, : 2 * k + 1]]))
        seeds = seeds[seeds != own]
        least = np.partition(q @ self.columns[:, seeds], -k)[-k] if len(seeds) >= k else floor
        read, seen = 0, np.zeros(len(self.ids), bool)
        if least > floor:
            essential = terms[: int(np.flatnonzero(rest < least - floor)[0])]
            slack = (least - floor - rest[len(essential)]) / bound[essential].sum()
            for t in essential.tolist():
                found = self._top(t, q[t], slack * bound[t])
                seen[found] = True
                read += len(found)
        else:
            seen[:] = True
        if own >= 0:
            seen[own] = False
        live = np.flatnonzero(seen)
        part = np.full(len(live), floor)
        for at in range(0, len(terms), STRIDE):
            some = terms[at : at + STRIDE]
            part = part + (q[some] @ self.columns[np.ix_(some, live)] - base[some].sum())
            if len(live) > k:
                front = live[np.argpartition(-part, k - 1)[:k]]
                least = max(least, (q @ self.columns[:, front]).min())
                keep = part + rest[min(at + STRIDE, len(terms))] >= least
                live, part = live[keep], part[keep]
        top = np.lexsort((self.ids[live], -part))[:k]
        return live[top], part[top].astype(np.int64), read


def maxscore(queries: np.ndarray, qids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[list[tuple[int, int, int]], int]:
    """(query, id, score) of each query's k best rows but its own, and the postings read. Rows sorted by id."""
    index, out, read = Postings(rows, ids, int(np.abs(queries).max())), [], 0
    at = np.searchsorted(ids, qids)
    for q, qid, i in zip(queries, qids.tolist(), at.tolist()):
        found, scores, n = index.best(q, i if i < len(ids) and ids[i] == qid else -1, k)
        out += zip([qid] * len(found), ids[found].tolist(), scores.tolist())
        read += n
    return out, read


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best other rows.

    Rows are dealt by hash into shards of about SHARD_ROWS; the queries, in blocks of about QUERY_ROWS, go to every shard,
    and each pair of a shard and a block is a task of bounded size. The shards' best k are then merged. Vectors of
    different lengths are compared only with vectors of their own length. Repeated rows (the same vec_id) count as one, of
    several vectors the smallest. Rows without vec_id and vectors that are null, empty or hold null or non-finite parts take
    no part. Equal scores go to the smaller vec_id. Empty table: empty result. Other columns are ignored.
    """
    rows = cut(integer_vectors(vectors).where("size(v) > 0").groupBy("vec_id").agg(F.min("v").alias("v")))
    n = rows.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n // (every * QUERY_ROWS)))
    dim = F.size("v").alias("dim")
    left = rows.select("*", dim, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = rows.where(f"vec_id % {every} = 0")
    right = asked.select("*", dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(a) and len(b):
            a, b = a.sort_values("vec_id"), b.sort_values("vec_id")
            got, _ = maxscore(np.stack(b["v"].to_numpy()), b["vec_id"].to_numpy(), np.stack(a["v"].to_numpy()), a["vec_id"].to_numpy(), k)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"])

    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(one, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
