"""Exact top-k by inner product with no-random-access aggregation of sorted lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, ship

#: Rows of a block of candidates and of a block of queries. A task holds one of each, and bounds for every pair.
CANDIDATES, QUERIES = 4096, 256


def nra(queries: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query, row numbers that hold its k best rows and all that tie with them (own[q]: a row left out).

    Each dimension has a list of the rows sorted by value, read from the end that its query weight favours.
    All lists are read to the same depth, which doubles. What is read of a row gives its known part; for
    what is not read yet, the value last read bounds it above and the list's far end bounds it below. The
    k-th largest lower bound is what outsiders must reach: rows whose upper bound is under it are out.
    Reading ends when no query can drop more by it than it costs to resolve the rest.

    queries and rows hold integers as floats, and no sum reaches 2**53, so all bounds are exact.
    """
    n, dims = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    ascending = np.take_along_axis(rows, order, axis=0)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    alive = np.ones((len(queries), n), bool)
    if own is not None:
        has = np.flatnonzero(own >= 0)
        alive[has, own[has]] = False
    floor = plus @ ascending[0] + minus @ ascending[-1]
    depth = min(n, max(k, n // 4))
    while True:
        top, bottom = rank >= n - depth, rank < depth
        seen_top, seen_bottom = np.where(top, rows, 0.0), np.where(bottom, rows, 0.0)
        known = plus @ seen_top.T + minus @ seen_bottom.T
        lower = known + floor[:, None] - (plus * ascending[0]) @ top.T - (minus * ascending[-1]) @ bottom.T
        edge_top, edge_bottom = ascending[n - depth], ascending[depth - 1]
        upper = known + (plus @ edge_top + minus @ edge_bottom)[:, None] - (plus * edge_top) @ top.T - (minus * edge_bottom) @ bottom.T
        lower[~alive] = -np.inf
        if n > k:
            bar = np.partition(lower, n - k, axis=1)[:, n - k]
            alive &= upper >= bar[:, None]
        if depth >= n or alive.sum(axis=1).max(initial=0) <= max(4 * k, n // 64):
            return [np.flatnonzero(a) for a in alive]
        depth = min(n, depth * 2)


def block_best(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a block of candidates for each query of a block, ties to the smaller id (none comes last)."""
    out = []
    for dims, part in c.groupby(c["v"].map(len)) if len(q) and len(c) else ():  # vectors of another length than the query's are no candidates
        asked = q[q["v"].map(len) == dims]
        if not len(asked) or not dims:
            continue
        rows, ask = np.stack(part["v"].to_numpy()), np.stack(asked["v"].to_numpy())
        ids, place = part["id"].to_numpy(), part["row"].to_numpy()
        order = part["id"].isna().to_numpy(), part["id"].fillna(0).to_numpy(np.int64), place
        at = {r: i for i, r in enumerate(place.tolist())}
        own = np.array([at.get(r, -1) for r in asked["row"].tolist()])
        exact = dims * int(np.abs(rows).max()) * int(np.abs(ask).max()) < 2**52
        found = nra(ask.astype(float), rows.astype(float), k, own) if exact else [np.delete(np.arange(len(rows)), o) if o >= 0 else np.arange(len(rows)) for o in own]
        for i, left in enumerate(found):
            score = rows[left] @ ask[i] if exact else np.array([sum(x * y for x, y in zip(r, ask[i].tolist())) for r in rows[left].tolist()], dtype=object)
            if exact:
                best = np.lexsort((order[2][left], order[1][left], order[0][left], -score))[:k]
            else:
                best = np.array(sorted(range(len(left)), key=lambda j: (-score[j], *(o[left[j]] for o in order)))[:k], dtype=np.int64)
            out.append(pd.DataFrame({"query_row": asked["row"].iloc[i], "query_id": asked["id"].iloc[i], "vec_id": pd.array(ids[left][best], dtype="Int64"), "row": place[left][best],
                                     "score": [int(x) for x in score[best]]}))
    return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "row": [], "score": []}).astype("int64")


def _upto(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of highest inner product, exact.

    Components become floor(scale * x). is_query is a Column over id_col. Vectors that are null, empty, or
    hold null or non-finite components take no part, nor do those with one of 2**62 or more after scaling. Every other row is a
    candidate, but for the query's own: rows that repeat an id are rows of their own, and each of them asks. Rows without
    id are candidates, last among ties. Scores beyond a long fail. A query only meets vectors of its own length. An empty
    table gives an empty result; other columns are ignored. Ties go to the smaller id.

    Queries and candidates are dealt into blocks by hash; every block of queries meets every block of
    candidates, each pair in one task of bounded size, and only k rows per query leave it.
    """
    ship(vectors.sparkSession)
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * float(scale) < float(2**62)))
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(fine)
            .select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v")))
    rows = checkpoint(rows.withColumn("asks", F.coalesce(is_query(F.col("id")), F.lit(False))).withColumn("row", F.monotonically_increasing_id()))
    n, nq = rows.agg(F.count("*"), F.count_if("asks")).first()
    cb, qb = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(nq / QUERIES))
    candidates = rows.select("id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(cb)).alias("c"), F.explode(_upto(qb)).alias("q"))
    queries = rows.where("asks").select("id", "row", "v", F.explode(_upto(cb)).alias("c"), F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(qb)).alias("q"))

    def run(q, c):
        return block_best(q, c, k)

    best = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInPandas(run, "query_row long, query_id long, vec_id long, row long, score long")
    by = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
