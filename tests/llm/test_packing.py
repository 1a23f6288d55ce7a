import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
from docdelta.llm.packing import ShardIndex, counted, fill, pack, pack_shard, term_vectors
from docdelta.llm.tokens import END, WordEncoder, default_path, encoder, source_of


def test_encoder_equals_whole_text_tokenization():
    rng = random.Random(2)
    alphabet = ["The", "don't", "É", "ét", "naïve,", "12.5%", "  ", "\n", "\t", " ", "\x1c", "ΣΑΣ", "<|endoftext|>", "a<|startoftext|>b", "日本", "x" * 80, "--'s", " "]
    texts = ["".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    e = encoder(default_path())
    got = e.encode([t.encode() for t in texts])
    for t, x in zip(texts, got, strict=True):
        assert np.frombuffer(x, e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_holds_no_object_of_every_word_and_makes_pieces_once():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdefgh", k=12)) + rng.choice([".", ",", ""]) for _ in range(100_000)})
    e = WordEncoder(source_of(default_path()), most=1000)
    text = " ".join(words).encode()
    tracemalloc.start()
    got = e.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.frombuffer(got[0], e.dtype).tolist() == e.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert peak < 30e6
    assert len(e.pieces) + len(e.pieces.old) <= 2 * (1 << 15) + 2000  # two slices of words

    e, made = WordEncoder(source_of(default_path())), []
    e.pieces.make = lambda p, make=e.pieces.make: made.append(p) or make(p)
    for _ in range(3):
        e.encode([b"One two, ONE", b"three one. two", b""])
    assert sorted(made) == sorted({"\n", "one", "two", "three", ",", "."})


def test_counts_of_all_documents_are_those_of_each():
    rng = np.random.default_rng(5)
    for kind in ("<u2", "<u4"):
        docs = [rng.integers(0, 30, rng.integers(1, 50)).astype(kind) for _ in range(300)]
        docs += [np.full(3, 65535, kind), np.zeros(0, kind), np.full(1 << 20, 7, kind), np.array([9, 8, 9], kind)]
        want = [np.unique(d, return_counts=True) for d in docs]
        terms, tf, sizes = counted(docs)
        assert sizes.tolist() == [len(t) for t, _ in want]
        assert terms.tolist() == [x for t, _ in want for x in t.tolist()] and tf.tolist() == [x for _, c in want for x in c.tolist()]
        idf, plane = rng.random(65536) + 0.1, rng.standard_normal((65536, 4), np.float32)
        got = term_vectors(docs, idf, 20.0, plane)
        for d, (t, c), v in zip(docs, want, got, strict=True):
            row = (idf[t] * c / (c + 1.2 * (0.25 + 0.75 * len(d) / 20.0))).astype(np.float32) @ plane[t]
            assert np.allclose(v, row / max(np.linalg.norm(row), 1e-9), atol=1e-5)


def check(rows, want, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(want[d])
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(want[d][p.start : at], "<u4").tobytes())
        assert at == len(want[d])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_round_trip(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "alpha beta gamma delta".split() for b in "one two three".split()]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 40, 300, 5000]))) for _ in range(60)] + [None, "", " "]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    tok = encoder(default_path()).tokenizer
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, END] for i, t in enumerate(texts)}
    for shard_tokens in (20_000, 10**9):
        check(pack(df, shard_tokens=shard_tokens).collect(), want, 4096)
    assert pack(df.limit(0)).count() == 0
    twice = pack(df.limit(3).union(df.limit(3))).collect()
    assert sum(r.length for r in twice) == 2 * sum(len(want[i]) for i in range(3))


def test_scores_and_neighbours():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50, rng.integers(5, 40)).astype("<u2") for _ in range(30)]
    idf, mean = rng.random(60) + 0.1, 20.0
    index = ShardIndex(docs, idf, mean)
    for seed in range(30):
        terms = set(docs[seed].tolist())
        want = [sum(idf[t] * (f := (d == t).sum()) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in terms) for d in docs]
        assert np.allclose(index.scores(seed), want)
    sequences = fill([10, 10, 10, 10], lambda seed, used: [3, 2, 1, 0], 20)
    assert sequences == [[(0, 0, 10), (3, 0, 10)], [(1, 0, 10), (2, 0, 10)]] or sequences[0] == [(0, 0, 10), (3, 0, 10)]


def test_all_terms_of_a_seed_rank():
    seed = np.arange(40, dtype="<u2")  # ids 0 to 19 are rarest and its own
    others = [np.arange(100 + 10 * i, 110 + 10 * i, dtype="<u2") for i in range(5)]
    close, closer = np.r_[seed[35:], others[0]].astype("<u2"), np.r_[seed[20:], others[1]].astype("<u2")
    idf = np.r_[np.full(20, 9.0), np.ones(180)]
    rows = pack_shard(0, list(range(8)), [seed, *others, close, closer], idf, 20.0, 85)
    assert [d for d, s in zip(rows["doc_id"], rows["sequence_id"]) if s == 0] == [0, 7, 6]


def test_ranked_is_a_stable_sort():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, rng.integers(1, 9)).astype("<u2") for _ in range(300)]
    index = ShardIndex(docs, rng.integers(1, 3, 60).astype(float), 5.0)
    used = rng.random(300) < 0.3
    for seed in range(20):
        scores = np.where(used, 0, index.scores(seed))
        assert list(index.ranked(seed, used)) == [i for i in np.argsort(-scores, kind="stable").tolist() if scores[i] > 0]
        want = sum(np.where([t in d for d in docs], [index.weight[index.starts[t] : index.starts[t + 1]][index.doc[index.starts[t] : index.starts[t + 1]] == i].sum() for i in range(300)], 0) for t in set(docs[seed].tolist()))
        assert np.allclose(index.scores(seed), want)


def test_lexical_neighbours_meet_in_a_shard(spark):
    rng = random.Random(6)
    topics = [[f"{a}{b}{c}" for a in rng.sample("bdfgklmnprst", 3) for b in "aeiou" for c in rng.sample("bdfgklmnprst", 2)] for _ in range(8)]
    texts = [" ".join(rng.choices(topics[i % 8], k=150)) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards = defaultdict(list)
    for r in pack(df, shard_tokens=20_000).select("doc_id", "sequence_id").distinct().collect():
        shards[r.sequence_id >> 32].append(r.doc_id % 8)
    assert len(shards) >= 4
    pairs = [a == b for s in shards.values() for i, a in enumerate(s) for b in s[:i]]
    assert sum(pairs) > 0.3 * len(pairs)  # one in eight by chance
    same = spark.createDataFrame([(i, texts[0]) for i in range(400)], "doc_id long, text string")
    rows = pack(same, shard_tokens=20_000).collect()
    assert len({r.doc_id for r in rows}) == 400 and len({r.sequence_id >> 32 for r in rows}) >= 4
