import duckdb
from docdelta.llm import licenses as L
from pyspark.sql import functions as F


def test_known_texts_match_through_layout_case_and_spelling(spark):
    mit = dict((i, t) for i, t in reversed(L.TEXTS))["MIT"]
    rows = [
        (1, mit),
        (2, "Copyright (c) 2019 Somebody\nAll rights reserved.\n" + mit.upper().replace(" ", "\n")),
        (3, mit.replace("license", "licence").replace(",", "").replace(". ", " -- ")),
        (4, mit + " extra"),
        (5, None), (6, ""), (7, " . , \n"),
        (8, "released under the MIT licence"),
        (9, "# © 2020 X\nLicensed under CC BY-NC 4.0"),
        (10, "licence licence licence licence"), (11, "license license license license"),
        (None, mit), (1, mit), (12, "word " * 200_000),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license_id string")
    got = L.scan(df).collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert {i: r.license_id for i, r in found.items()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None, 8: "MIT", 9: "CC-BY-NC-4.0", 10: None, 11: None, None: "MIT", 12: None}
    assert found[10].digest == found[11].digest and found[5].digest == found[7].digest
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(L.oracle()).fetchall(), key=str) == sorted((tuple(r) for r in got), key=str)


def test_tables(spark):
    df = spark.createDataFrame([(1, "My Own Licence!")], "doc_id long, text string")
    own = L.known(spark, [("own", "my own license"), ("another", "MY, OWN, LICENSE"), ("none", "...")])
    assert [tuple(r)[::2] for r in L.scan(df, own).collect()] == [(1, "another")]
    assert L.scan(df.limit(0)).count() == 0
    twice = own.union(own.withColumn("license_id", F.lit("zz")))
    assert [r.license_id for r in L.scan(df, twice).collect()] == ["another"]


def test_full_texts_are_found(spark):
    """Every licence that is shipped, in other letters, layout and with a copyright line of its own."""
    texts = [(i, t) for i, t in L.known_texts() if len(t) > 300]
    assert len({i for i, _ in texts}) >= 20
    rows = [(k, f"(c) 2021 Some Body\n\n{t.upper() if k % 2 else t}".replace(", ", " ,\t").replace("Licence", "License")) for k, (_, t) in enumerate(texts)]
    df = spark.createDataFrame([*rows, *[(1000 + k, t[: len(t) // 2]) for k, t in rows]], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in L.scan(df).collect()}
    assert [got[k] for k in range(len(texts))] == [i for i, _ in texts]
    assert not any(got[1000 + k] for k in range(len(texts)))
