"""Exact top-k search against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentloom.llm import maxscore

SCHEMA = "vec_id long, embedding array<float>, number string, q string"


def brute(rows, k):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, (i, a) in enumerate(kept):
        if i is None or i % 20:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), j is None, j or 0, j) for s, (j, b) in enumerate(kept) if s != r]
        out += [(i, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    got = maxscore.top_k(df, F.col("vec_id") % 20 == 0, k)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted(map(tuple, got.collect()), key=str)


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in v] for v in np.float32(rng.normal(0, 0.2, (n, dims)))]


def test_against_brute(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 50)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 7)
    monkeypatch.setattr(maxscore, "TILE_SHARDS", 2)
    monkeypatch.setattr(maxscore, "HEAD", 30)
    rows = list(enumerate(vectors(1, 400, 16)))
    # Equal vectors, a repeated id, missing ids, unusable and shorter vectors.
    rows += [(500 + i, rows[20][1]) for i in range(60)] + [(40, rows[3][1]), (40, rows[40][1]), (None, rows[20][1]), (None, rows[5][1])]
    rows += [(600, None), (620, [None] * 16), (640, [float("nan")] * 16), (660, [float("inf")] * 16), (680, []), (700, rows[0][1][:5])]
    assert run(spark, rows) == brute(rows, 20)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(i, [float(i % 2)]) for i in range(30)]], ids=["none", "one", "few"])
def test_small(spark, rows):
    assert run(spark, rows) == brute(rows, 20)


def test_large_components(spark):
    rows = [(i, [3e5 * (i % 7), -2e5 * (i % 5), 1.5]) for i in range(60)]
    assert run(spark, rows, 5) == brute(rows, 5)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [1e10]), (1, [1e10])])


def test_most_rows_are_not_probed():
    """On vectors in clusters most rows fall out after the essential terms."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 8, (200, 64))
    values = np.floor(centres[rng.integers(0, 200, 8000)] + rng.normal(0, 1, (8000, 64))).astype(np.int64)
    order = np.argsort(values.T, axis=1)
    shard = {"terms": values.T.astype(np.int8), "ids": np.arange(8000), "known": np.ones(8000, bool), "number": np.arange(8000),
             "low": order[:, :64], "high": order[:, ::-1][:, :64]}
    asked = {k: shard[k][..., :100] for k in ("terms", "ids", "known", "number")}
    best = [maxscore._Best(20) for _ in range(100)]
    probed = maxscore.search(asked, shard, best)
    full = values[:100] @ values.T
    full[np.arange(100), np.arange(100)] = -(1 << 60)
    assert all((np.sort(full[i])[::-1][:20] == best[i].score).all() for i in range(100))
    assert probed < 0.6 * 100 * 8000
