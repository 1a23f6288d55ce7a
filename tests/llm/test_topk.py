import math

import numpy as np
import pytest
from docdelta.llm.topk import top_k
from pyspark.sql import functions as F


def brute(rows, k):
    ok = [(i, vid, [math.floor(64 * float(np.float32(x))) for x in v]) for i, (vid, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, vid, q in ok:
        if vid is not None and vid % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), w if w is not None else 1 << 62, j) for j, w, v in ok if j != i)[:k]
            out += [(vid, n + 1, w if w != 1 << 62 else None, -s) for n, (s, w, _) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["random", "ties", "clusters", "norms"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    v = rng.normal(0, 0.2, (300, 8))
    if kind == "ties":
        v = np.round(v * 2) / 2
        v[50:150] = v[0]
    elif kind == "clusters":
        v = v * 0.1 + rng.normal(0, 1, (5, 8))[rng.integers(0, 5, 300)]
    elif kind == "norms":
        v *= rng.exponential(1, (300, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (420, [None] * 8), (440, [math.nan] * 8), (None, v[3].tolist()), (460, [0.5, 1.0]), (0, v[7].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rid int")
    for block in (16, 8192):
        got = top_k(df, F.col("vec_id") % 20 == 0, k=20, pivots=6, block=block)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 20)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 4096)]
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert top_k(df.limit(1), F.col("vec_id") % 20 == 0).count() == 0
