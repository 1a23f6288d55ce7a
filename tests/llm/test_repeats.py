import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from docdelta.llm import repeats as R


def brute(texts, w):
    starts = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - w + 1):
            starts[t[i : i + w]].append((d, i))
    out = []
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + w] = True
    for t, g in zip(texts, gone, strict=True):
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((len(t), int(g.sum()), len(R.runs(g)), hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(size // 3) for _ in range(4)]
    out = [text(rng.choice([0, 1, size // 2, size, 3 * size])) for _ in range(25)]
    out += [text(size // 4) + rng.choice(passages) + text(size // 4) for _ in range(25)]
    out += out[5:9] * 2
    for t in out[:12]:  # near copies
        cut = rng.randrange(len(t) + 1)
        out.append(t[:cut] + "X" + t[cut:])
    out += ["a" * 700, "a" * 300, "ab" * 400 + "c", "ba" * 350, "xyz" * 200 + text(30) + "xyz" * 200, "", text(2) + passages[0][:60]]
    return out


def test_suffix_order_and_statistics():
    rng = np.random.default_rng(0)
    for text in (rng.integers(0, 3, 300), np.zeros(50, int), rng.integers(0, 257, 400), np.tile([1, 2, 3], 60), np.array([5])):
        order = R.suffix_order(text)
        t = text.tolist()
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])

        def lcp(i, j):
            k = 0
            while max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            return k

        index = R.RunIndex(text)
        assert index.matching_statistics().tolist() == [max((lcp(i, j) for j in range(len(t)) if j != i), default=0) for i in range(len(t))]
        assert len(index.starts) <= len(t)


def test_every_window_holds_an_anchor_chosen_by_its_bytes(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choices(b"abc", k=3000)) + b"a" * 500
    for block in (1 << 20, 700):
        monkeypatch.setattr(R, "BLOCK", block)
        at, h = R.anchors(text, 64, 16)
        places = dict(zip(at.tolist(), h.tolist()))
        for i in range(len(text) - 63):
            own, _ = R.anchors(text[i : i + 64], 64, 16)
            assert len(own) == 1 and i + own[0] in places


@pytest.mark.parametrize(("hot", "chunk", "huge"), [(10**6, 1 << 20, 10**6), (2, 2000, 10**6), (2, 2000, 3), (0, 2000, 0)])
def test_against_brute_force(spark, hot, chunk, huge):
    texts = corpus(hot, 60)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, place string")
    got = {r.doc_id: tuple(r)[1:] for r in R.remove(df, 48, 24, hot, chunk, with_text=True, huge=huge).collect()}
    want = brute([t.encode() for t in texts], 48)
    for i, w in enumerate(want):
        assert (*got[i][:4], bytes(got[i][4])) == w, i
    assert sum(w[1] for w in want) > 5000


def test_production_width_and_edges(spark):
    rng = random.Random(7)
    a = "".join(rng.choices("abcdefgh ", k=900))
    rows = [(1, "1" + a[:399] + "2"), (2, "3" + a[:399] + "4"), (3, "5" + a[100:500] + "6"), (4, "7" + a[100:500] + "8"), (5, None), (None, ""), (6, a), (6, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in R.remove(df).collect()), key=str)
    assert got == sorted([(1, 401, 0, 0), (2, 401, 0, 0), (3, 402, 400, 1), (4, 402, 400, 1), (5, 0, 0, 0), (None, 0, 0, 0), (6, 900, 900, 1), (6, 900, 900, 1)], key=str)
    assert R.remove(df.limit(0)).count() == 0


def test_suffix_order_of_a_long_array():
    text = np.random.default_rng(1).integers(0, 3, (1 << 21) + 100)
    text[-(1 << 12) :] = text[: 1 << 12]
    order = R.suffix_order(text)
    assert (np.bincount(order, minlength=len(text)) == 1).all()
    codes = (text + 1).astype(np.uint8).tobytes()
    pairs = zip(order[:-1].tolist(), order[1:].tolist())
    assert all(codes[a : a + 5000] < codes[b : b + 5000] for a, b in pairs)


@pytest.mark.parametrize("huge", [R.HUGE, 5000])
def test_passage_of_many_documents_with_distinct_continuations(spark, huge):
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh ", k=420))
    texts = [f"{i % 97}{passage}{i * 7919 % 20_011:05d}" + "".join(rng.choices("xyz", k=40)) for i in range(20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    times = Counter(hash(t[i : i + 400]) for t in texts for i in range(len(t) - 399))
    got = {r.doc_id: r.n_removed for r in R.remove(df, huge=huge).collect()}
    for d, t in enumerate(texts):
        twice = [i for i in range(len(t) - 399) if times[hash(t[i : i + 400])] > 1]
        assert got[d] == len({x for i in (twice[0], twice[-1]) for x in range(i, i + 400)}), d
