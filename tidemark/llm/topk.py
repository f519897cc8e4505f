"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt to blocks by a hash of their id and queries to groups; each (query group, block) pair is one task's
work, and every vector goes to each query group once, every query to each block once. In a block each dimension's list
is sorted; a query reads its lists from the end that its sign favours, in steps, scores what it has not seen yet by
exact integer products, and stops once the threshold (the sum of its components times the values at the depth reached)
is below its k-th score. At equality it reads on, since a smaller id may still tie. The k best of each block meet in
one window for each query, k rows from each block.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; components are
floor(scale * x) as doubles; a block with components so large that a sum could leave 64 bits is scored in Python's
integers, and a score beyond 64 bits is shown as the nearest one but ranked by its own value; vectors of other lengths than the query's
are no candidates; rows that repeat an id are candidates of their own, except of a query with that id; a query without
candidates has no rows; further columns are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import parts_for

STEP = 32
BLOCK_ROWS = 16384
GROUP_QUERIES = 2048


def threshold_topk(lists: np.ndarray, order: np.ndarray, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best candidates of a block for one query.

    lists[d] holds dimension d's values in ascending order, order[d] the rows they belong to.
    """
    n, dims = vectors.shape
    use = np.flatnonzero(query)
    if not len(use):
        use = np.arange(1)
    up = query[use] > 0
    seen = np.zeros(n, bool)
    top_ids, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = 0
    while depth < n:
        end = min(n, depth + step)
        rows = np.concatenate([order[use[up], n - end : n - depth].ravel(), order[use[~up], depth:end].ravel()])
        rows = np.unique(rows[~seen[rows]])
        seen[rows] = True
        rows = rows[ids[rows] != own]
        if len(rows):
            top_ids, top = np.concatenate([top_ids, ids[rows]]), np.concatenate([top, vectors[rows] @ query])
            best = np.lexsort((top_ids, -top))[:k] if top.dtype != object else np.array(sorted(range(len(top)), key=lambda i: (-top[i], top_ids[i]))[:k], np.int64)
            top_ids, top = top_ids[best], top[best]
        at = np.where(up, lists[use, n - end], lists[use, end - 1])
        if len(top) == k and int(at @ query[use]) < top[-1]:
            break
        depth, step = end, step * 2
    return top_ids, top


LONG = 2**63 - 1


def in_order(x: int) -> bytes:
    """Bytes that compare as the integers do: sign, number of bytes, bytes; the latter two turned over below zero."""
    raw = abs(x).to_bytes((abs(x).bit_length() + 7) // 8, "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return b"\x01" + raw if x >= 0 else b"\x00" + bytes(255 - c for c in raw)


def finite(vector: Column) -> Column:
    """The vector as doubles, null if it takes no part."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: x.cast("double")))


def top_k(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score; is_query is a condition on a column `vec_id`."""
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v")).where("vec_id is not null")
    valid = rows.select("vec_id", finite(F.col("v")).alias("v")).where("v is not null").withColumn("dims", F.size("v"))
    counts = rows.select(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, groups = parts_for(counts["n"], block_rows), parts_for(counts["q"], group_queries)
    own = F.xxhash64("vec_id")
    # both sides' keys must have one type: an int and a long of one value are dealt to different partitions
    candidates = valid.withColumn("block", F.pmod(own, F.lit(blocks)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = valid.where(is_query).withColumn("grp", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out = "query_id long, vec_id long, score long, beyond binary, copy long"

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Ids and whole vectors, the first two columns."""
        flat = table.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids = table.column(0).to_numpy().astype(np.int64)
        whole = np.floor(flat * scale)
        most = float(np.abs(whole).max()) if len(flat) else 0.0
        if most < 2.0**27:  # products below 2^54: sums of up to 512 fit
            whole = whole.astype(np.int64)
        else:
            whole = np.array([math.floor(Fraction(x) * scale) for x in flat.tolist()], object)
        return ids, whole.reshape(len(ids), -1)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.num_rows and held.num_rows:
            ids, vectors = matrix(held)
            order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
            lists = np.take_along_axis(np.ascontiguousarray(vectors.T), order, axis=1)
            q_ids, q = matrix(asked)
            if object in (q.dtype, vectors.dtype) or vectors.shape[1] > 512:
                q, vectors, lists = q.astype(object), vectors.astype(object), lists.astype(object)
            for own_id, vec in zip(q_ids.tolist(), q, strict=True):
                got, score = threshold_topk(lists, order, vectors, ids, vec, own_id, k)
                found.append((np.full(len(got), own_id, np.int64), got, score))
        cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        scores = [int(x) for x in cols[2].tolist()]
        shown = [max(-LONG, min(LONG, x)) for x in scores]
        beyond = pa.array([None if x == y else in_order(x) for x, y in zip(scores, shown, strict=True)], pa.binary())
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": pa.array(shown, pa.int64()), "beyond": beyond, "copy": np.arange(len(cols[0]))})

    # names of their own, so that Spark can tell the sides apart
    keys, names = ["grp", "block", "dims"], ["vec_id", "v", "grp", "block", "dims"]
    asked_rows = queries.select(*[F.col(n).alias(f"asked_{n}") for n in names]).groupBy(*[f"asked_{n}" for n in keys])
    best = asked_rows.cogroup(candidates.select(*names).groupBy(*keys)).applyInArrow(search, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.when(F.col("score") > 0, F.col("beyond")).desc_nulls_last(), F.col("beyond").desc_nulls_first(), "vec_id", "copy"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
