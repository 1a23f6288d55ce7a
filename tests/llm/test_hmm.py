import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from docdelta.llm import hmm


def random_model(K, S, seed=0):
    rng = np.random.default_rng(seed)
    emit = rng.random((S, K))
    move = rng.random((K, K))
    start = rng.random(K)
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


@pytest.mark.parametrize("segment", [512, 1, 2, 3])
def test_forward_and_expected_counts_match_all_paths(segment, monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    m = random_model(3, 5)
    ids = [np.array(x, np.uint16) for x in ([0], [1, 2, 3], [4, 4, 0, 2, 1], [3, 3], [])]
    total = np.zeros(3 + 9 + 15 + 1)
    hmm.expected(m, ids, total)
    want = np.zeros_like(total)
    likes = []
    for x in ids[:-1]:
        paths = list(itertools.product(range(3), repeat=len(x)))
        p = np.array([m.start[z[0]] * np.prod([m.move[a, b] for a, b in zip(z, z[1:])]) * np.prod([m.emit[s, k] for s, k in zip(x, z)]) for z in paths])
        likes.append(np.log10(p.sum()))
        for z, w in zip(paths, p / p.sum()):
            want[z[0]] += w
            for a, b in zip(z, z[1:]):
                want[3 + 3 * a + b] += w
            for s, k in zip(x, z):
                want[12 + 5 * k + s] += w
        want[-1] += np.log(p.sum())
    assert np.allclose(total, want, rtol=1e-4)
    assert np.allclose(hmm.log_likelihoods(m, ids), [*likes, 0])


def test_long_texts_and_segments(monkeypatch):
    m = random_model(4, 9)
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 9, n).astype(np.uint16) for n in (1, 2, 513, 514, 1025, 3000, 0)]
    plain = hmm.log_likelihoods(m, ids)
    monkeypatch.setattr(hmm, "LONG", 1)
    assert np.allclose(hmm.log_likelihoods(m, ids), plain)
    flat, off, lens, first, last = hmm.segments(ids)
    assert np.array_equal(np.concatenate([flat[o : o + n] for o, n in zip(off, lens)]), np.concatenate(ids)) and first.sum() == last.sum() == 6
    found = []
    for length in (7, 512, 4096):
        monkeypatch.setattr(hmm, "SEGMENT", length)
        found.append(np.zeros(4 + 16 + 36 + 1))
        hmm.expected(m, ids, found[-1], 1000)
    assert np.allclose(found[0], found[2], rtol=1e-3) and np.allclose(found[1], found[2], rtol=1e-3)
    assert np.isclose(found[0][-1] / np.log(10), plain.sum()) and np.isclose(found[0][20:-1].sum(), sum(map(len, ids)), rtol=1e-4)


def test_probabilities_and_base(spark):
    rng = random.Random(3)
    a, b = [f"w{i}" for i in range(14)], [f"É{i}v" for i in range(14)]
    texts = [" ".join(rng.choices(rng.choice([a, b]), k=rng.randrange(1, 60))) for _ in range(80)] + [None, "", "NEVER seen", "W1 w1 W1"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, rid string")
    got = {r.doc_id: r for r in hmm.score(df, rounds=2, bounds=(12, 5, 4)).collect()}
    tokens = {i: [*((t or "").encode().lower().split()), b""] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    N, V = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), N)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (N + 0.1 * (V + 1))) for w in t))
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_model_is_a_distribution(spark):
    """All words of a known vocabulary, and an unseen one in each class, share one probability mass."""
    words = [f"w{i:02d}x".encode() for i in range(30)]
    counts = spark.createDataFrame([(w, 40 - i) for i, w in enumerate(words)], "word binary, c long")
    v = hmm.vocabulary(counts, 7, 100, 5, 4)
    shares = Counter()
    for w, i in v.rank.items():
        if v.symbol[i] > 5:
            shares[int(v.symbol[i])] += v.count[i] + 0.1
    for s in range(6, 10):
        assert v.mass[s] == pytest.approx(shares[s] + 0.1)
    assert v.mass.sum() == pytest.approx(7.1 + sum(40 - i + 0.1 for i in range(30)) + 0.4)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "x " * 30000)], "doc_id long, text string")
    got = hmm.score(rows).collect()
    assert len(got) == 4 and all(np.isfinite([r.score, r.base_score]).all() for r in got)
