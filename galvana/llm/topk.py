"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

The candidates are dealt by a hash of their id into shards of about SHARD_VALUES components, each to one shard. In a shard every
dimension has the list of its rows sorted by value. For a query the lists are read from the end that its weight favours,
all to the same depth; rows met for the first time are scored in full, and reading stops when the sum of weight times
value at the depth, which bounds every row not yet met, is below the shard's kth score, or below the kth score that the
query brings along from the shard that it asked first. The shards' answers, k rows a query at most, are merged by a
grouped top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
#: Components of a shard that holds as much as a task should; the lists and their values take 24 bytes for each.
SHARD_VALUES = 1 << 22
#: Rows of a shard while the table is too small to give every core one of full size.
LEAST_ROWS = 8192
QUERY_EVERY = 100
FIRST_DEPTH = 16
#: Sums below this are exact in double precision, which multiplies much faster than integers.
EXACT_DOUBLE = 1 << 53
LONG = 1 << 63


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v: array<long>) with floor(1024 * x) of each component; vectors that are null, or hold a null or a
    non-finite component, are left out, and so are rows without an id."""
    finite = F.forall(
        F.col("e"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
        .where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite)
        .select("vec_id", F.transform("e", lambda x: F.floor(x * SCALE)).alias("v"))
    )


class SortedLists:
    """Rows of one shard with a list of row numbers for each dimension, by rising value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[by_id], values[by_id]
        self.lists = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.lists, 0)

    def top(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than those with id `own`; ties go to the smaller id. Rows that score
        below `floor` may be left out."""
        n, used = len(self.ids), np.flatnonzero(query)
        up = query[used] > 0
        seen = self.ids == own
        best_rows, best_scores = np.zeros(0, np.int64), np.zeros(0, self.values.dtype)
        done, depth = 0, min(n, max(FIRST_DEPTH, k))
        while True:
            ends = np.where(up[None, :], n - 1 - np.arange(done, depth)[:, None], np.arange(done, depth)[:, None])
            met = self.lists[ends, used[None, :]].ravel() if len(used) else np.arange(n)
            new = np.zeros(n, bool)
            new[met] = True
            new &= ~seen
            seen |= new
            rows = np.flatnonzero(new)
            scores = self.values[rows] @ query
            best_rows, best_scores = np.r_[best_rows, rows], np.r_[best_scores, scores]
            if len(best_rows) > k:  # rows rise with ids, so the row breaks ties
                keep = np.lexsort((best_rows, -best_scores))[:k]
                best_rows, best_scores = best_rows[keep], best_scores[keep]
            if depth == n or seen.all():
                break
            last = np.where(up, n - depth, depth - 1)
            bound = self.sorted[last, used] @ query[used]
            if len(best_rows) == k and bound < best_scores.min() or floor is not None and bound < floor:
                break
            done, depth = depth, min(n, 2 * depth)
        if floor is not None:
            best_rows, best_scores = best_rows[best_scores >= floor], best_scores[best_scores >= floor]
        return self.ids[best_rows], best_scores


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    values = np.zeros((len(sizes), dims), np.int64)
    values[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return values


def _search(k: int, dims: int, bound: int):
    """Over rows sorted by shard, candidates before queries: each query's best in the shard. A shard's lists stay while its
    queries stream past, so candidates are sent once. `bound` is above every score: beyond 64 bits, numbers of any length
    are used, and only a score among the best that doesn't fit is an error."""
    kind = np.float64 if bound < EXACT_DOUBLE else np.int64 if bound < LONG else object

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, index = None, [], None
        for batch in batches:
            shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ids, floors = batch.column(2).to_numpy(), batch.column(4).to_pylist()
            values = _matrix(batch.column(3), dims).astype(kind)
            out: list[list] = [[], [], []]
            edges = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])])
            for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(shards)], strict=True):
                if shards[a] != shard:
                    shard, held, index = shards[a], [], None
                if not asks[a]:
                    held.append((ids[a:z], values[a:z]))
                    continue
                if index is None and held:
                    index = SortedLists(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                for q in range(a, z) if index else ():
                    found, scores = index.top(values[q], ids[q], k, floors[q])
                    if kind is object and any(abs(x) >= LONG for x in scores):
                        raise ValueError(f"a score of query {ids[q]} doesn't fit 64 bits")
                    for column, x in zip(out, (np.full(len(found), ids[q]), found, scores), strict=True):
                        column.append(x)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    query_every: int = QUERY_EVERY,
    shard_rows: int | None = None,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row whose id is divisible by `query_every`, its k best others.

    All candidates if there are fewer than k; ties go to the smaller vec_id. Vectors with null or non-finite parts take no
    part. A shorter vector counts as filled up with zeros. Rows that repeat an id are one candidate each and are all left
    out for a query of that id; a query id that repeats is answered once, for its least vector. Other columns are
    ignored; an empty table gives an empty one. Scores are 64-bit integers; where one among the best doesn't fit, the job
    fails with that message.

    Shards have `shard_rows` rows, or as many as SHARD_VALUES components make; smaller ones are taken while there are fewer
    shards than cores, down to LEAST_ROWS. Each query is sent to every shard, so larger shards mean fewer copies.

    Every query first asks the shard that its own id falls into; its kth score there goes along to the other shards as a
    floor, below which they neither read on nor answer.
    """
    rows = written(quantised(vectors, id_col, vector_col), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("decimal(20,0)"))))).alias("most")).first()
    n, dims, most = sizes["n"], max(sizes["dims"] or 0, 1), int(sizes["most"] or 0)
    if shard_rows is None:
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        shard_rows = max(1, min(SHARD_VALUES // dims, max(LEAST_ROWS, -(-n // cores))))
    shards = max(1, -(-n // shard_rows))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    none = F.lit(None).cast("long")
    candidates = rows.select(home.alias("shard"), F.lit(False).alias("asks"), "vec_id", "v", none.alias("floor"))
    queries = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def answers(asked: DataFrame) -> DataFrame:
        dealt = candidates.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "asks")
        return dealt.mapInArrow(_search(k, dims, most * most * dims), "query_id long, vec_id long, score long")

    at_home = written(answers(queries.select(home.alias("shard"), F.lit(True).alias("asks"), "vec_id", "v", none.alias("floor"))), "home-answers")
    floors = at_home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    away = queries.withColumn("home", home).join(floors, "vec_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    away = away.where("shard != home").select("shard", F.lit(True).alias("asks"), "vec_id", "v", "floor")
    met = at_home.unionByName(answers(away)) if shards > 1 else at_home
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB's answer to the registered query; repeated ids aside, which the driver's tables don't have.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
