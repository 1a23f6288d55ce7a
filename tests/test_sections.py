from docdelta.operators import layout, sections
from pyspark.sql import functions as F

KEY = "pair_id string, side string"
BLOCKS = f"{KEY}, block_ord int, page_index int, text string, max_size double, lines array<struct<text:string,size:double>>"


def blocks(spark, *rows):
    """(page, text, size) or (page, [(text, size), ...])."""
    out = []
    for i, r in enumerate(rows):
        lines = [(r[1], r[2])] if isinstance(r[1], str) else r[1]
        out.append(("p", "v1", i, r[0], " ".join(t for t, _ in lines), max(s for _, s in lines), lines))
    return spark.createDataFrame(out, BLOCKS)


def body(spark, size):
    return spark.createDataFrame([("p", "v1", size)], f"{KEY}, body_size double")


def pages(spark, *texts):
    from docdelta.functions.text import normalize_text

    df = spark.createDataFrame([("p", "v1", i, t) for i, t in enumerate(texts)], f"{KEY}, page_index int, text string")
    return df.withColumn("normalized_text", normalize_text(F.col("text"))).drop("text")


def built(df):
    return sorted(df.collect(), key=lambda r: r.order_index)


def outline(spark, *rows):
    return layout.outline(spark.createDataFrame([("p", "v1", i, 1, t, p) for i, (t, p) in enumerate(rows)], f"{KEY}, ord int, level int, title string, page int"))


def test_outline_builder(spark):
    entries = outline(spark, ("Introduction", 1), ("1 General information", 2), ("Contents", 3))
    stream = blocks(
        spark, (0, "Introduction", 12.0), (0, "This is the intro body text.", 9.0), (1, "1 General information", 12.0), (1, "General body prose here.", 9.0),
        (1, "General information", 9.0), (1, "BIG BANNER", 20.0), (2, "Contents", 12.0), (2, "1 General information .... 2", 9.0),
    )
    got = built(sections.outline_sections(entries, stream, body(spark, 9.0)))
    assert [s.full_title for s in got] == ["Introduction", "1 General information", "Contents"]
    assert got[1].normalized_text == "General body prose here." and [s.comparison_enabled for s in got] == [True, True, False]
    assert [(s.page_start, s.page_end) for s in got] == [(1, 2), (2, 3), (3, 3)]
    assert [s.section_id for s in got] == ["sec_introduction", "sec_1", "sec_contents"] and got[0].page_map[0].asDict() == {"page": 1, "text": "This is the intro body text."}


def test_outline_reliability(spark):
    assert layout.outline_is_reliable(outline(spark, ("1 A", 1), ("2 B", 1), ("C", 1))).first().outline_available is False
    assert layout.outline_is_reliable(outline(spark, ("1 A", 1), ("2 B", 1), ("2.1 C", 0), ("", 1))).first().outline_available is True


def test_font_builder(spark):
    stream = blocks(
        spark, (0, "Introduction", 12.0), (0, "Intro body prose.", 9.0), (1, [("2.1 ", 11.0), ("ECC implications", 11.0)]), (1, "Body about ECC here.", 9.0),
        (1, "NOTE: callout", 11.0), (2, "5 Conclusion", 12.0), (2, "Closing words.", 9.0),
    )
    got = built(sections.font_sections(stream, body(spark, 9.0)))
    assert [s.full_title for s in got] == ["Introduction", "2.1 ECC implications", "5 Conclusion"]
    assert "Body about ECC here." in got[1].normalized_text and got[1].parent_section_id == "sec_2" and got[1].level == 2
    assert sections.font_sections(blocks(spark, (0, "just text", 9.0)), body(spark, 9.0)).count() == 0


def test_lone_numbers_take_in_the_next_heading_line(spark):
    stream = blocks(spark, (0, [("1", 12.0), ("2", 12.0), ("3", 12.0), ("Title words", 12.0), ("text", 9.0)]))
    got = built(sections.font_sections(stream, body(spark, 9.0)))
    assert [(s.number, s.title) for s in got] == [("1", "2"), ("3", "Title words")]


def test_numbered_lines_across_pages(spark):
    got = built(sections.pattern_sections(pages(spark, "1 Introduction\nOld intro text\n2 Clock tree\nClock details", "2.1 PLL\nPLL details\nMore PLL details")))
    assert [s.number for s in got] == ["1", "2", "2.1"] and got[2].parent_section_id == "sec_2"
    assert "PLL details" in got[2].normalized_text and "2 Clock tree" not in got[0].normalized_text
    assert [(s.page_start, s.page_end) for s in got] == [(1, 1), (1, 2), (2, 2)]


def test_whole_document(spark):
    got = built(sections.pattern_sections(pages(spark, "plain document text")))
    assert len(got) == 1 and got[0].section_id == "sec_document" and got[0].title == "Document" and got[0].comparison_enabled


def test_table_rows_and_contents_are_no_headings(spark):
    text = "1 General information\nUseful prose\n16 11 10 16 24 40 51 61\n99 99 99 99 99 99 99 99\n2 Hardware codec overview ..................... 3\n2 Hardware codec overview\nMore prose"
    got = built(sections.pattern_sections(pages(spark, text)))
    assert [s.full_title for s in got] == ["1 General information", "2 Hardware codec overview"]
    assert "16 11 10" not in got[0].normalized_text and "....." not in got[0].normalized_text


def test_steps_and_resets_are_no_headings(spark):
    text = "3 Bootloader command set\n3.1 Get command\n1. Byte 1: ACK\n2. Byte 2: N = 10 = Number of commands\n3. Wait for ACK or NACK\n3.2 Get version command\nUseful prose"
    assert [s.full_title for s in built(sections.pattern_sections(pages(spark, text)))] == ["3 Bootloader command set", "3.1 Get command", "3.2 Get version command"]
    text = "1 General information\n2 ECC overview\n2.1 ECC implications\n1 AXI bus is 64b, but this is a footnote.\n2 Only the first 256 KB of SRAM3.\n2.2 RAM ECC\n3 ECC testing\n1 Select a flash page.\n"
    assert [s.number for s in built(sections.pattern_sections(pages(spark, text)))] == ["1", "2", "2.1", "2.2", "3"]


def test_echo_keys(spark):
    df = spark.createDataFrame([("p", "v1", "", "Appendix A ECC sequences"), ("p", "v1", "2.2", "RAM ECC"), ("p", "v1", "", "FAR")], f"{KEY}, number string, title string")
    keys = {r.key for r in sections.echo_keys(df).collect()}
    assert {"eccsequences", "appendixaeccsequences", "ramecc", "22ramecc"} == keys


def test_numbering_of_many_documents_is_folded_in_batches(spark):
    rows = [(d, "v1", 0, i, n, "Part") for d in range(300) for i, n in enumerate(["1", "1.1", "3", "1.2", "2", "4", "0.5"])]
    candidates = spark.createDataFrame(rows, "pair_id long, side string, page_index int, line int, number string, title string")
    kept = sections.hierarchy_filter(candidates.repartition(2))
    # One Python call a group of rows costs more than the fold itself: no group crosses to Python alone.
    assert "FlatMapGroups" not in kept._jdf.queryExecution().toString()
    got = {}
    for r in kept.orderBy("line").collect():
        got.setdefault(r.pair_id, []).append(r.number)
    assert len(got) == 300 and all(x == ["1", "1.1", "1.2", "2", "4", "0.5"] for x in got.values()) and kept.columns == candidates.columns
