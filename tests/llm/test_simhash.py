import random

import numpy as np
import pytest
import xxhash
from docdelta.llm import simhash as S
from docdelta.llm.simhash import ball_links, fingerprint, jaccard, keep_one, shingle_set, simhash_components


def brute(texts):
    def fp(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fp(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    return fps, group


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("ab cd ef gh ij KL mn".split()) for _ in range(rng.choice([1, 2, 3, 5, 60, 300]))) for _ in range(25)]
    texts = [*base, *base[:5], None, "", " \t\n", "x", "É x", "A b c d"]
    texts += [t + " end" for t in base]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs).collect()}
    fps, group = brute(texts)
    assert got == {i: (f"{f:016x}", g) for i, (f, g) in enumerate(zip(fps, group, strict=True))}


def test_links_connect_all_near_pairs(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({s ^ (1 << a) ^ (1 << b) for s in seeds for a in range(5) for b in range(5)} | {0, (1 << 64) - 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for distance in (1, 2, 3):
        df = spark.createDataFrame([(v,) for v in signed], "fp long")
        parent = {v: v for v in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in ball_links(df, distance).collect():
            assert ((u ^ v) & (1 << 64) - 1).bit_count() <= distance
            parent[root(u)] = root(v)
        for i, a in enumerate(signed):
            for b in signed[:i]:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                    assert root(a) == root(b)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(rows).collect()), key=str)
    assert got == [(3, 3), (3, 3), (7, 7), (None, 3)]
    assert sorted((r.doc_id for r in keep_one(rows).collect()), key=str) == [3, 7, None]
    assert fingerprint(b"word " * 200_000) == fingerprint(b"word word word word")


def test_keep_one_reaches_similarity(spark):
    rng = random.Random(9)
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(words)
        changed = list(words)
        for at in rng.sample(range(5, 195), 4):  # about 0.82 where the shingles don't overlap
            changed[at] = f"new{at}"
        texts.append(changed if i % 2 else words[:100] + changed[:100])
    texts = [" ".join(w) for w in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in keep_one(df).collect()}
    sets = [shingle_set(t.encode()) for t in texts]
    wide = 0
    for i in range(0, 120, 2):
        assert i in kept
        s = jaccard(sets[i], sets[i + 1])
        far = (fingerprint(texts[i].encode()) ^ fingerprint(texts[i + 1].encode())).bit_count() > 2
        assert (i + 1 in kept) == (s < 0.8 and far)
        wide += s >= 0.8 and far
    assert wide > 20


def test_first_pairs_grow_with_the_members():
    key, tid = np.r_[np.full(300, 7), np.full(9, 8), 9], np.arange(310)
    found, large = S.first_pairs(key, tid)
    assert large.tolist() == [7] and len(found) == 299 + 36
    assert {(u, v) for u, v in found.tolist() if u < 300} == {(u, 0) for u in range(1, 300)}
    assert {(u, v) for u, v in found.tolist() if u >= 300} == {(u, v) for u in range(300, 309) for v in range(300, u)}


@pytest.mark.parametrize(("small", "hot", "limit"), [(8, 1 << 18, 8), (1, 1 << 18, 1), (1, 30, 1)])
def test_large_bands_lose_no_link(spark, monkeypatch, small, hot, limit):
    """Hundreds of copies of one text, each with edits of its own: many are near only one or two others."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(160)]
    texts = []
    for i in range(260):
        words = list(base)
        for k in range(rng.choice([2, 2, 3, 5])):
            words[rng.randrange(160)] = f"own{i}.{k}"
        texts.append(words)
        if i % 4 == 0:
            other = list(words)
            for k in range(4):
                other[rng.randrange(160)] = f"other{i}.{k}"
            texts.append(other)
    texts = [" ".join(w) for w in texts]
    sets = [shingle_set(t.encode()) for t in texts]
    keys = [set(S.band_keys(x).tolist()) for x in sets]
    fps = [fingerprint(t.encode()) for t in texts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if keys[i] & keys[j] and jaccard(sets[i], sets[j]) >= 0.8 or (fps[i] ^ fps[j]).bit_count() <= 2]
    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        group[b] = a
    monkeypatch.setattr(S, "SMALL", small)
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "CELL", 16)
    if hot < 100:
        monkeypatch.setattr(S, "DRAWN", 1)
    monkeypatch.setattr(S.similar_roots, "__defaults__", (0.8, 5, limit))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in keep_one(df).collect()}
    assert kept == {i for i in range(len(texts)) if root(i) == i}
    assert 5 < len(kept) < len(texts) - 60
