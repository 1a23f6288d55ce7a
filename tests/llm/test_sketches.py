import hashlib
import random

import pytest
import xxhash
from docdelta.llm import sketches as S
from pyspark.sql import functions as F


def hashes(text):
    words = text.encode().lower().split()
    out = set()
    for i in range(max(len(words) - 4, min(1, len(words)))):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w, h)
        out.add(h >> 16)
    return out


def near(a, b, k):
    sa, sb = sorted(a)[:k], sorted(b)[:k]
    if not a or not b:
        return float(a == b)
    union = sorted(set(sa) | set(sb))
    if len(sa) == k or len(sb) == k:
        union = union[:k]
    return len(set(union) & set(sa) & set(sb)) / len(union)


def brute(rows, k):
    rows = [(d, t or "") for d, t in rows]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        line = lambda x: "".join(f"{h:012x}" for h in sorted(hashes(x))[:k])
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), line(t), line(edited), near(hashes(t), hashes(edited), k), near(hashes(t), hashes(after), k))
    return out


@pytest.mark.parametrize("step", [1, 977, 10**15])
def test_against_brute_force(spark, step, monkeypatch):
    rng = random.Random(step)
    words = ["aa", "Bé", "c d", "ee,", "日本語", "𝄞x"]
    rows = [(i * step - 5, " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 5, 6, 40, 400])))) for i in range(50)]
    rows += [(None, "null key one two three four"), (10**17, None), (10**17 + 1, "\n x \t y  "), (10**17 + 2, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, bucket string")
    monkeypatch.setattr(S.with_next, "__defaults__", (7,))
    got = {r.doc_id: tuple(r)[1:] for r in S.fingerprints(df, 16).collect()}
    want = brute(rows, 16)
    assert set(got) == set(want)
    for d in want:
        assert got[d][:4] == want[d][:4] and got[d][4:] == pytest.approx(want[d][4:])


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.fingerprints(empty).count() == 0
    one = S.fingerprints(spark.createDataFrame([(1, "a b c d e f g")], empty.schema)).first()
    assert one.near_next == 1 and one.near_edited < 1
    twice = S.fingerprints(spark.createDataFrame([(1, "a b c")] * 3 + [(2, "x " * 100_000)], empty.schema)).collect()
    assert len(twice) == 4 and len({r.fingerprint for r in twice if r.doc_id == 1}) == 1


def test_merge_and_estimates(spark):
    rng = random.Random(1)
    parts = [(i % 3, " ".join(rng.choices([f"w{j}" for j in range(300)], k=500))) for i in range(12)] + [(9, "")]
    df = spark.createDataFrame(parts, "g int, text string").select("g", S.sketch(F.col("text")).alias("sketch"))
    got = {r.g: r.sketch for r in S.merged(df, ["g"]).collect()}
    for g in (0, 1, 2, 9):
        assert got[g] == sorted(set().union(*(hashes(t) for k, t in parts if k == g)))[:128]
    a = " ".join(f"a{i}" for i in range(5000))
    b = a + " " + " ".join(f"b{i}" for i in range(5000))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(S.sketch(F.col("a")).alias("a"), S.sketch(F.col("b")).alias("b"))
    row = row.select(S.resemblance(F.col("a"), F.col("b")).alias("r"), S.containment(F.col("a"), F.col("b")).alias("c"), S.distinct_count(F.col("b")).alias("n")).first()
    assert row.r == pytest.approx(0.5, abs=0.15) and row.c > 0.75 and row.n == pytest.approx(10_000, rel=0.3)
