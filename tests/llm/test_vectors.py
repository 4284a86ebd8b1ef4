import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvana.llm import topk


def plain(vectors, every, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
            out[q] = [(rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("shard", [8192, 40])
def test_top_k(spark, shard):
    rng = np.random.default_rng(3)
    vectors = [(i, np.float32(rng.normal(0, 0.2, 12)).tolist()) for i in range(300)]
    vectors += [(400 + i, vectors[7][1]) for i in range(30)]  # ties
    vectors += [(500, None), (600, [1.0, None]), (700, [float("nan")] * 12), (800, [0.0] * 12), (900, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = {}
    for r in topk.top_k(df, query_every=20, shard_rows=shard).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert found == plain(vectors, 20, 10)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [0.5, -0.5]), (1, [0.25, 0.25])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 0)]
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_repeated_ids_and_clashing_columns(spark):
    """Rows of a query's own id are no candidates for it; other rows that repeat an id are one each."""
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.25, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("shard", "asks", "v", "score", "floor")})
    want = [(0, 1, 1, 512 * 1024), (0, 2, 1, 512 * 1024), (0, 3, 2, 512 * 256)]
    for shard_rows in (8192, 1):
        assert [tuple(r) for r in topk.top_k(df, shard_rows=shard_rows).orderBy("rank").collect()] == want


def test_components_too_large_for_the_scores(spark):
    big = spark.createDataFrame([(0, [4e6, 1.0]), (1, [4e6, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(big).collect()
    apart = spark.createDataFrame([(0, [4e6, 1.0]), (1, [0.0, 2.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")  # only the bound is too large
    for shard_rows in (None, 1):
        assert [(r.vec_id, r.score) for r in topk.top_k(apart, shard_rows=shard_rows).orderBy("rank").collect()] == [(2, 4_000_000 << 20), (1, 2 << 20)]
    wide = spark.createDataFrame([(0, [2e6, 1.0]), (1, [2e6, 2.0]), (2, [2e6, 3.0])], "vec_id long, embedding array<double>")  # beyond doubles, within 64 bits
    assert [r.score for r in topk.top_k(wide).orderBy("rank").collect()] == [(1024 * 2_000_000) ** 2 + 1024 * 1024 * x for x in (3, 2)]
