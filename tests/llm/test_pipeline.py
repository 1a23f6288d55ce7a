import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline as P
import numpy as np
import pytest
from docdelta.llm.simhash import fingerprint
from docdelta.llm.tokens import END, default_path, encoder


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = {"aa": "the of and tion ing was".split(), "bb": "der und schen keit ung war".split()}
    rows, labels = [], []
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        words = [rng.choice(vocab[lang]) + rng.choice("abcdefgh") for _ in range(rng.randrange(20, 200))]
        if i % 5 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), lang, "src0", 0))
        if i % 3:
            labels.append((i, int(i % 5 != 0), 0))
    rows += [(1000 + i, rows[i][1], rows[i][2], "src1", 0) for i in range(40)]
    rows += [(2000, None, "aa", "s", 0), (2001, "12 34", "aa", "s", 0), (2002, rows[1][1] + " mail a.b@c.org now", None, "s", 0)]
    rows = [(*r[:4], len(r[1] or "")) for r in rows]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before, last = docs.columns, {r.doc_id: r for r in docs.collect()}, None
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "language_id":
            assert {r.doc_id for r in rows} == set(before) - {2000, 2001}
            assert next(r.lang for r in rows if r.doc_id == 2002) == "aa"
        elif name == "near_duplicates":
            kept = {r.doc_id: fingerprint(r.text.encode()) for r in rows}
            gone = {i: fingerprint(r.text.encode()) for i, r in last.items() if i not in kept}
            assert not any(i >= 1000 and before[i].text == before[i - 1000].text for i in kept if 1000 <= i < 2000)
            values = list(kept.values())
            assert not any((a ^ b).bit_count() <= 2 for n, a in enumerate(values) for b in values[:n])
            assert all(any((f ^ g).bit_count() <= 2 for g in [*values, *gone.values()] if g is not f) for f in gone.values())
        elif name == "personal_data":
            changed = {r.doc_id: r.text for r in rows if r.text != before[r.doc_id].text}
            assert set(changed) == ({2002} & set(last)) and all(re.search(r"mail \w\.\w@d\w+\.example\.org now$", t) for t in changed.values())
        elif name == "mixing":
            assert {r.doc_id for r in rows} <= set(last) and {i for i in last if i % 5 and i < 400} <= {r.doc_id for r in rows}
        else:
            e = encoder(default_path())
            want = defaultdict(list)
            for r in docs.collect():
                want[r.doc_id].append([*e.tokenizer.encode(r.text, add_special_tokens=False).ids, END])
            assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
            for r in rows:
                ids = want[r.doc_id][0]
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        docs, last = out, {r.doc_id: r for r in rows}


def test_run(spark, folder):
    out = P.run(spark, folder)
    assert out.columns[:2] == ["doc_id", "start"] and out.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, p string, text_hash int, copies int, n_entities string, h int, rid int, `row` string"


@pytest.mark.parametrize("kind", ["empty", "odd", "no labels"])
def test_edges_and_clashing_columns(spark, tmp_path, kind):
    """Nulls in any column, repeated rows, empty and long texts, and columns named like the stages' own helpers."""
    words = "the of and tion ing was one two three four".split()
    text = lambda k: " ".join(words[(k * 7 + j * (k + 3)) % 10] + "abcdefgh"[(k + j) % 8] for j in range(30 + k))
    rows = [] if kind == "empty" else [(k, text(k), "aa", "s", 3, "keep", 7, 8, "nine", 1, 2, "r") for k in range(40)]
    if kind != "empty":
        rows += [rows[5], rows[5], (None, text(50), "aa", None, None, None, None, None, None, None, None, None), (None,) * 12, (60, "", "aa", "", 0, "", 0, 0, "", 0, 0, "")]
        rows += [(61, "word " * 60_000, None, "s", 300_000, "keep", 7, 8, "nine", 1, 2, "r"), (7, text(7) + " call +1 (743) 555-3824", "aa", "s", 1, "keep", 7, 8, "nine", 1, 2, "r")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = [] if kind != "odd" else [(k, k % 2, 0) for k in range(40)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert docs.count() >= len(kept)
            continue
        kept = docs.collect()
        assert docs.columns == columns and (kept or kind == "empty" or name == "mixing")
        assert all((r.p, r.text_hash, r.copies, r.n_entities, r.h, r.rid, r.row) == ("keep", 7, 8, "nine", 1, 2, "r") for r in kept if r.doc_id is not None and r.doc_id != 60)
        if name == "near_duplicates" and kind != "empty":
            ids = [r.doc_id for r in kept]
            assert ids.count(5) == 1 and ids.count(7) == 1 and None in ids and 61 in ids
