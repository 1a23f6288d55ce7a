import numpy as np
import pytest
from docdelta.llm import mixing as M
from pyspark.sql import functions as F


def corpus(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        k = rng.choice(3, p=[0.6, 0.3, 0.1])
        words = rng.choice([f"w{j}" for j in range(200)], rng.integers(5, 200)).tolist()
        if k == 1:
            words = [w + "###" for w in words]
        if k == 2:
            words.insert(int(rng.integers(len(words))), "nastyword")
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(k != 1), int(k == 2)))
    return rows, labels


def brute_rates(n, p, targets):
    """Plain projected gradient descent on all rates in the metric of the tokens, from 1."""
    w, r = n / n.sum(), np.ones(len(n))
    for _ in range(200_000):
        miss = (w * r) @ p - targets
        if np.abs(miss).max() < 1e-10:
            break
        r = np.maximum(0, r - p @ miss)
    return r


@pytest.mark.parametrize("targets", [[0.5, 0.3, 0.2], [0.05, 0.05, 0.9], [0.9, 0.1, 0.0]])
def test_rates_meet_targets(spark, targets):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(0, 100, 200)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    steps, left = M.fit_rates(df, np.array(targets))
    r = np.array([x[0] for x in df.select(M.rate(F.col("p"), steps)).collect()])
    miss = lambda r: np.square((n / n.sum() * r) @ p - targets).sum()
    plain = miss(brute_rates(n.astype(float), p, np.array(targets)))
    assert (r >= 0).all() and (miss(r) < 1e-12 if plain < 1e-12 else miss(r) < plain + 1e-4)


def test_mix_and_classifier(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 0.5) for r in [*rows, (900, None), (901, ""), (None, "w1 w2"), (3, rows[3][1]), (902, "w1 " * 100_000)]], "doc_id long, text string, rate double")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    targets = {"good": 0.5, "poor": 0.3, "toxic": 0.2}
    got = M.mix(docs, marks, targets).collect()
    assert len(got) == len(rows) + 5
    p = np.array([[r.p_good, r.p_poor, r.p_toxic] for r in got])
    n, r = np.array([x.n_tokens for x in got]), np.array([x.rate for x in got])
    assert np.abs((n * r) @ p / n.sum() - [0.5, 0.3, 0.2]).max() < 1e-6
    assert np.allclose(p.sum(axis=1), 1) and all(x.copies in (int(x.rate), int(x.rate) + 1) for x in got)
    held = {i for i, *_ in rows} - {i for i, *_ in labels}
    truth = {i: 1 if "###" in t else 2 if "nastyword" in t else 0 for i, t in rows}
    right = [int(np.argmax([x.p_good, x.p_poor, x.p_toxic])) == truth[x.doc_id] for x in got if x.doc_id in held]
    assert np.mean(right) > 0.9
    out = M.apply_mix(docs, marks, targets)
    assert out.columns == docs.columns
    copies = {}
    for x in got:
        copies[x.doc_id] = copies.get(x.doc_id, 0) + x.copies
    counted = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {i: n for i, n in copies.items() if n}


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert M.mix(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a b"), (2, None)], docs.schema)
    assert M.mix(one, labels).count() == 2
