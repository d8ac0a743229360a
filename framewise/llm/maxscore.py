"""Exact top-k search by inner product with MaxScore over impact-ordered dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.llm.common import stored, table

FOUND = "query_id long, query_key long, vec_id long, score long"
STEP = 256  # documents scored between two updates of the threshold


def as_matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros to ``width``."""
    out = np.zeros((len(lists), width), np.int64)
    row = 0
    for chunk in lists.chunks:
        sizes = np.diff(chunk.offsets.to_numpy())
        flat = chunk.flatten().to_numpy()
        rows = np.repeat(np.arange(row, row + len(sizes)), sizes)
        places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[rows, places] = flat
        row += len(sizes)
    return out


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int,
                 low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a shard whose ids ascend; ties keep the smaller id.

    A dimension is a term, and its posting of a vector is the distance from the end of the shard's
    range at which the query gains least, so that postings are never negative and a term's bound is
    its weight times the range.  Terms are ordered by bound.  The last terms, whose bounds together
    cannot lift the least possible score above the k-th best, are non-essential: vectors gather the
    essential postings first, and only those still competitive probe the others.
    """
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    least = np.where(query >= 0, query * low, query * high)
    bounds = np.where(query >= 0, query * high, query * low) - least
    order = np.argsort(-bounds, kind="stable")
    floor = least.sum()
    rest = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0]])
    weights = query[order]
    for at in range(0, len(ids), STEP):
        some = np.flatnonzero(ids[at : at + STEP] != query_id) + at
        full = len(best) == k
        threshold = best[-1] if full else None
        # rest[j] bounds the terms from j on: they are non-essential if floor + rest[j] <= threshold
        essential = int(np.argmax(floor + rest <= threshold)) if full and floor + rest[-1] <= threshold else len(order)
        if full and essential == 0:
            break
        score = vectors[np.ix_(some, order[:essential])] @ weights[:essential] + least[order[essential:]].sum()
        j = essential
        while j < len(order) and len(some):
            alive = score + rest[j] > threshold
            some, score = some[alive], score[alive]
            upto = min(len(order), j + 8)
            cut = order[j:upto]
            score = score + vectors[np.ix_(some, cut)] @ weights[j:upto] - least[cut].sum()
            j = upto
        if full:
            alive = score > threshold
            some, score = some[alive], score[alive]
        if len(some):
            best_ids = np.concatenate([best_ids, ids[some]])
            best = np.concatenate([best, score])
            pick = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[pick], best[pick]
    return best_ids, best


def shard_searcher(k: int):
    schema = pa.schema([(c, pa.int64()) for c in ("query_id", "query_key", "vec_id", "score")])

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(shard) and len(queries):
            sizes = [x for t in (shard, queries) for c in t["vec"].chunks for x in np.diff(c.offsets.to_numpy())]
            width = max(sizes, default=0)
            ids = shard["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], as_matrix(shard["vec"], width)[order]
            low, high = vectors.min(0), vectors.max(0)
            asked = as_matrix(queries["vec"], width)
            for qid, key, query in zip(queries["vec_id"].to_pylist(), queries["key"].to_pylist(), asked):
                found, score = search_shard(ids, vectors, qid, query, k, low, high)
                for column, values in zip(out, (np.full(len(found), qid), np.full(len(found), key), found, score)):
                    column.append(values)
        return pa.table([np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in out], schema=schema)

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    shard_rows: int = 2048,
    block_rows: int = 1024,
) -> DataFrame:
    """For each query row the ``k`` highest integer inner products among all other rows.

    Components become ``floor(scale * x)``.  Rows are dealt into shards of about ``shard_rows`` and
    queries into blocks of about ``block_rows``; each pair of a shard and a block is one bounded
    task, and the shards' best are merged per query.  Returns ``query_id, rank, vec_id, score``.

    Defined cases: vectors that are NULL or hold a NULL or non-finite component, and rows without
    id, take no part; a row that repeats id and vector counts once; rows with the query's id are
    not its candidates; vectors of unlike length count as filled up with zeros.
    """
    spark = vectors.sparkSession
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vec = F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    clean = stored(
        vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
        .select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), is_query.alias("asks"))
        .distinct()
        .withColumn("key", F.xxhash64("vec_id", "vec")),
        "vectors",
    )
    n, asked = clean.agg(F.count("*"), F.coalesce(F.count_if("asks"), F.lit(0))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    deal = lambda count: F.pmod(F.col("key"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>"))
    left = clean.select("vec_id", "vec", deal(shards).alias("shard"), every(blocks).alias("block"))
    right = clean.where("asks").select("vec_id", "vec", "key", deal(blocks).alias("block"), every(shards).alias("shard"))
    found = (
        left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(shard_searcher(k), FOUND)
    )
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


OP10_SQL = """
WITH clean AS (
  SELECT DISTINCT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
parts AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM clean),
bad AS (SELECT DISTINCT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)),
whole AS (
  SELECT vec_id, i, CAST(floor(1024 * x) AS BIGINT) AS x FROM parts
  WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
  GROUP BY q.vec_id, c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
