"""Exact top-k search by inner product with MaxScore.

Terms are the components of the integer vectors.  A query's term has a score
bound: the most its posting list can add over the least it adds.  Terms are
split by these bounds: the non-essential ones are those that together can't
lift a vector from the least score to the k-th best so far, so the postings of
the essential terms are traversed, and the other terms are probed only for
vectors that are still competitive, most valuable term first.

Every vector is in one shard, every query in one block, and each (block, shard)
pair is one task-sized group, so memory is bounded by the two sizes however
many vectors there are.  A shard returns the best k of each query in its block;
the merge ranks at most k rows per query and shard.

Shards hold their vectors in order of vec_id, so a later vector that only
equals the k-th best score loses the tie and needs no probing.

Defined cases: a vector that is null or holds a null or a non-finite component,
or has no vec_id, takes no part; vectors of different lengths are compared on
the components both have (so an empty vector scores 0 with all, ties by vec_id); a query that repeats a vec_id is asked once, with
its smallest vector; candidates are all rows with another vec_id, repeated
rows included; fewer than k candidates are all returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.text import table
from tillroll.storage import written

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Vectors of a shard and queries of a block: what a task holds at a time.
SHARD_ROWS, BLOCK_ROWS = 4096, 2048
#: Vectors scored between two looks at the k-th best score.
STEP = 1024


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )


def max_score(shard: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one shard for one query: (ids, scores), best first.

    ``shard`` has a row per term and a column per vector, in order of ids; its numbers and
    those of ``query`` are whole, in a float type that holds every partial sum exactly.
    """
    ends = query[:, None] * np.stack([shard.min(axis=1), shard.max(axis=1)], axis=1)
    least, bounds = ends.min(axis=1), np.abs(ends[:, 1] - ends[:, 0])
    order = np.argsort(-bounds, kind="stable")
    query, least_sum = query[order], least.sum()
    # What the terms from position i on can still add, over the least they add.
    rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
    least_rest = np.append(np.cumsum(least[order][::-1])[::-1], 0)
    best_ids, best = np.zeros(0, ids.dtype), np.zeros(0, shard.dtype)
    for begin in range(0, shard.shape[1], STEP):
        end = min(begin + STEP, shard.shape[1])
        at = np.arange(begin, end)
        full = len(best) >= k
        threshold = best[-1] if full else -np.inf
        # Essential terms: without them no vector gets over the threshold.
        essential = len(order) if not full else int(np.argmax(least_sum + rest <= threshold)) if (least_sum + rest <= threshold).any() else len(order)
        if essential == 0:
            continue
        score = query[:essential] @ shard[order[:essential], begin:end]
        done = essential
        while done < len(order):
            competitive = score + least_rest[done] + rest[done] > threshold
            at, score = at[competitive], score[competitive]
            if not len(at):
                break
            more = min(len(order), done + 8)
            score = score + query[done:more] @ shard[order[done:more]][:, at]
            done = more
        if not len(at):
            continue
        other = ids[at] != own
        if full:
            other &= score > threshold
        best_ids, best = np.concatenate([best_ids, ids[at[other]]]), np.concatenate([best, score[other]])
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
    return best_ids, best


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """List column as rows of equal width; shorter rows end in zeros."""
    lengths = pa.compute.list_value_length(column).to_numpy()
    flat = pa.compute.list_flatten(column).to_numpy()
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    begin = np.cumsum(lengths) - lengths
    for i, (b, n) in enumerate(zip(begin, lengths)):
        out[i, :n] = flat[b : b + n]
    return out


FOUND = "query_id long, vec_id long, score long"


def _search_group(k: int):
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            none = [pa.array([], pa.int64())] * 3
            return pa.Table.from_arrays(none, names=["query_id", "vec_id", "score"])
        # Empty vectors are compared as vectors of one zero.
        width = max(1, *(pa.compute.max(pa.compute.list_value_length(t.column("v"))).as_py() for t in (queries, vectors)))
        asked, shard = _matrix(queries.column("v"), width), _matrix(vectors.column("v"), width)
        asked_ids, ids = queries.column("id").to_numpy(), vectors.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, shard = ids[order], shard[order]
        # Partial sums and bounds stay below this, so a float type with enough bits is exact.
        most = 4.0 * width * (float(np.abs(asked).max(initial=0)) + 1) * (float(np.abs(shard).max(initial=0)) + 1)
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        shard, asked = np.ascontiguousarray(shard.T.astype(kind)), asked.astype(kind)
        parts = [max_score(shard, ids, asked[i], int(asked_ids[i]), k) for i in range(len(asked))]
        return pa.Table.from_arrays(
            [pa.array(np.repeat(asked_ids, [len(p[0]) for p in parts])),
             pa.array(np.concatenate([p[0] for p in parts])),
             pa.array(np.concatenate([p[1] for p in parts]).astype(np.int64))],
            names=["query_id", "vec_id", "score"],
        )

    return search


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id long, v array<long>) against the same -> query_id, rank, vec_id, score."""
    n_queries, n_vectors = queries.count(), vectors.count()
    blocks, shards = max(1, math.ceil(n_queries / block_rows)), max(1, math.ceil(n_vectors / shard_rows))
    salted = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    # Rows that repeat an id are dealt apart by their place in the file, so no shard outgrows the rest.
    dealt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    left = queries.withColumn("block", salted(blocks, 1)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = written(vectors.withColumn("shard", dealt), "shards").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_search_group(k), FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), scaled(F.col("embedding")).alias("v"))
    queries = vectors.where(F.col("id") % QUERY_EVERY == 0).groupBy("id").agg(F.min("v").alias("v"))
    return top_k(queries, vectors)


# All pairs, ranked: for small tables.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
