"""Exact top-k by inner product: columnar branch and bound.

Queries and candidates are dealt to a grid of blocks; a task gets one block of either. It keeps the candidates in
vertical layout (one row per dimension) and adds up inner products one block of dimensions at a time. What the
dimensions still to come can add is bounded by the product of the two remaining norms; a candidate whose upper bound
is below a query's k-th best lower bound is out, and the survivors are compacted before the next block. The k best of
each grid cell meet in a ranked merge.

Components are floor(256 * x) as whole numbers, so scores are exact. Results do not depend on the blocks.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null id take no part;
vectors are compared with vectors of the same length only; rows with the query's id are the query's own; a repeated
query is answered once, a repeated candidate is a candidate each time; with fewer than k candidates all are returned; equal scores rank by smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and dimensions added between two bounds.
QUERY_BLOCK, CANDIDATE_BLOCK, DIMENSIONS = 4096, 16384, 16
#: Queries and candidates of one dense step inside a task.
QUERY_STEP, CANDIDATE_STEP = 128, 4096
EXACT = 2.0 ** 52


def whole_components(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): valid vectors as arrays of whole numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return vectors.where(F.col(key).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int):
    """(query index, id, score) of the k best candidates of each query, by branch and bound."""
    width = queries.shape[1]
    big = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * width
    kind = np.float64 if big < EXACT else np.int64  # products and sums below 2**52 are exact in floating point
    found = []
    tail = np.arange(0, width + DIMENSIONS, DIMENSIONS).clip(max=width)
    for q0 in range(0, len(queries), QUERY_STEP):
        q, own = queries[q0:q0 + QUERY_STEP].astype(kind), query_ids[q0:q0 + QUERY_STEP]
        q_rest = [np.sqrt((q[:, t:].astype(np.float64) ** 2).sum(1)) for t in tail]
        floor = np.full(len(q), -np.inf)  # k-th best score so far
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c0 in range(0, len(candidates), CANDIDATE_STEP):
            vertical = np.ascontiguousarray(candidates[c0:c0 + CANDIDATE_STEP].T).astype(kind)
            names = ids[c0:c0 + CANDIDATE_STEP]
            c_rest = [np.sqrt((vertical[t:].astype(np.float64) ** 2).sum(0)) for t in tail]
            partial = np.zeros((len(q), len(names)), kind)
            alive = np.arange(len(names))  # candidates that some query may still want
            mine = names[None, :] == own[:, None]
            for b in range(len(tail) - 1):
                low, high = tail[b], tail[b + 1]
                partial += q[:, low:high] @ vertical[low:high][:, alive]
                slack = np.outer(q_rest[b + 1], c_rest[b + 1][alive]) * (1 + 1e-9)
                upper = partial + slack
                if len(alive) > k:
                    lower = np.where(mine, -np.inf, partial - slack)
                    floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
                stays = (upper >= floor[:, None]).any(0)
                if not stays.all():
                    alive, partial, mine = alive[stays], partial[:, stays], mine[:, stays]
            score = partial if kind is np.int64 else np.rint(partial).astype(np.int64)
            qi, ci = np.nonzero((score >= floor[:, None]) & ~mine)
            best.append((qi, names[alive][ci], score[qi, ci]))
        qi, name, score = (np.concatenate(x) for x in zip(*best))
        order = np.lexsort((name, -score, qi))
        qi, name, score = qi[order], name[order], score[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = place < k
        found.append((qi[top] + q0, name[top], score[top]))
    return [np.concatenate(x) for x in zip(*found)]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score from two frames (vec_id, v) of whole-number vectors."""
    spark = queries.sparkSession
    n_queries, n_candidates = queries.count(), candidates.count()
    across = max(1, -(-n_queries // query_block))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, -(-n_candidates // candidate_block), min(-(-n_candidates // 1024), spread))

    def place(df: DataFrame, own: int, others: int, is_query: bool) -> DataFrame:
        mine, theirs = F.pmod(F.xxhash64("vec_id"), F.lit(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        first, second = (mine, theirs) if is_query else (theirs, mine)
        return df.select(first.alias("a"), second.alias("b"), F.size("v").alias("width"),
                         F.lit(is_query).alias("asks"), "vec_id", "v")

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(rows: pa.Table) -> pa.Table:
        width = rows.column("width")[0].as_py()
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        names = rows.column("vec_id").to_numpy()
        values = np.asarray(rows.column("v").combine_chunks().flatten(), np.int64).reshape(len(names), width)
        values = values if width else np.zeros((len(names), 1), np.int64)
        if not asks.any() or asks.all():
            return schema.empty_table()
        q, name, score = best_in_block(values[asks], names[asks], values[~asks], names[~asks], k)
        return pa.Table.from_arrays([pa.array(names[asks][q]), pa.array(name), pa.array(score)], schema=schema)

    cells = place(queries, across, down, True).unionByName(place(candidates, down, across, False))
    near = cells.groupBy("a", "b", "width").applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(embeddings: DataFrame) -> DataFrame:
    """The five best of all rows for every row whose id is divisible by 50."""
    vectors = whole_components(embeddings)
    return top_k(vectors.where(F.col("vec_id") % 50 == 0).distinct(), vectors)


NEAREST_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
