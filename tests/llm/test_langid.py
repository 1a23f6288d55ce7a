import numpy as np
from docdelta.llm.langid import ByteCNN, accept, language_id, windows

WORDS = {"aa": "the of and tion ing".split(), "bb": "der und schen keit ung".split(), "cc": "que los cion mente año".split()}


def docs_of(n, seed=0):
    rng = np.random.default_rng(seed)
    langs = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]], rng.integers(3, 400))), langs[i % 3]) for i in range(n)]


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 508, 509, 5000):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        rows, held = windows(data)
        for k, row in enumerate(rows):
            want = data[k * 252 : k * 252 + 256]
            assert bytes(row[: len(want)].astype(np.uint8)) == want and (row[len(want) :] == 256).all()
        assert max(0, n - 4) <= 252 * len(rows)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = ByteCNN(["a", "b", "c"], filters=3, dim=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, target = rng.integers(0, 256, (5, 32)), np.array([0, 1, 2, 1, 0])

    def loss():
        return -np.log(net.posteriors(rows)[np.arange(5), target]).mean()

    g = net.gradients(rows, target)
    for name in ("out", "bias", "w3", "b2", "emb"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_held_out_accuracy_and_edges(spark):
    rows = [*docs_of(240), (900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "cc"), (903, "the of and tion ing " * 50_000, None), (None, "der und", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and got[None].lang_pred == "bb"
    held = [(got[i], lang) for i, _, lang in rows[:240] if got[i].held_out]
    assert len(held) > 20 and np.mean([g.lang_pred == lang for g, lang in held]) > 0.95
    kept = accept(df)
    assert kept.columns == df.columns
    ids = {r.doc_id: r.lang for r in kept.collect()}
    assert not {900, 901, 902} & set(ids) and ids[903] == "aa" and len(ids) >= 238


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id(empty).count() == 0
    none = spark.createDataFrame([(1, "abc", None)], empty.schema)
    assert language_id(none).first().lang_pred == "und"


def test_predictions_against_plain_loops(spark):
    """Every window of every text through plain loops over bytes, filters and widths."""
    import random

    import numpy as np
    from docdelta.llm import langid

    rng = random.Random(5)
    net = langid.ByteCNN(["aa", "bb", "cc"], filters=3, dim=2, seed=3)
    texts = ["", None, "1 2 3", "x", "Straße €5 \U0001d11e"] + ["".join(rng.choices("abcdeäß .,1", k=n)) for n in (5, 255, 256, 257, 510, 1300)]

    def posterior(window):
        hidden = []
        for w in net.widths:
            for f in range(net.filters):
                best = max(sum(float(net.p["emb"][window[i + j]] @ net.p[f"w{w}"][j * net.dim : (j + 1) * net.dim, f]) for j in range(w)) for i in range(len(window) - w + 1))
                hidden.append(max(0.0, best + float(net.p[f"b{w}"][f])))
        z = np.exp(np.array(hidden) @ net.p["out"] + net.p["bias"])
        return z / z.sum()

    want = {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        if not any(c.isalpha() for c in t or ""):
            want[i] = ("und", 0.0)
            continue
        total, weights = np.zeros(3), 0.0
        for k in range(max(1, -(-max(0, len(data) - 4) // 252))):
            part = data[252 * k : 252 * k + 256]
            total += posterior([*part, *[256] * (256 - len(part))]) * len(part)
            weights += len(part)
        want[i] = (net.classes[int(total.argmax())], total.max() / weights)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, net).collect()}
    assert {i: r.lang_pred for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(abs(got[i].score - w[1]) < 1e-4 for i, w in want.items())
