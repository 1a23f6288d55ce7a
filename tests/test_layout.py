from docdelta.operators import layout as L
from pyspark.sql import functions as F

KEY = "pair_id string, side string"


def test_lost_spaces_come_back(spark):
    chars = [(0, "a", 0.0, 5.0), (1, "b", 5.0, 10.0), (2, "c", 13.0, 18.0), (3, " ", 18.0, 20.0), (4, "d", 25.0, 30.0), (5, "SPAN", None, 60.0), (6, "e", 70.0, 75.0), (7, "", 0.0, 0.0)]
    df = spark.createDataFrame([(1, *c, 10.0) for c in chars], "line int, char_no int, c string, x0 double, x1 double, size double")
    assert L.reconstruct_lines(df, ["line"]).first().text == "ab c dSPAN e"


def test_clusters(spark):
    rects = [(0, 0, 50, 50), (55, 0, 100, 50), (300, 300, 310, 301), (10, 10, 10, 20), (200, 0, 250, 40), (90, 0, 195, 50)]
    df = spark.createDataFrame([([dict(zip(("x0", "y0", "x1", "y1"), map(float, r))) for r in rects],)], "r array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = [tuple(c) for c in df.select(L.cluster_rects(F.col("r")).alias("c")).first().c]
    assert got == [(0, 0, 195, 50), (200, 0, 250, 40)]  # clusters that come to touch stay apart


def test_extraction(spark):
    line = lambda block, no, text, size, y0, x0=50.0, kind=0: ("p", "v1", 0, block, no, kind, 50.0, y0, x0, y0, x0 + 400, y0 + 10, text, size, 800.0)
    rows = [
        line(0, 0, "Running header", 9.0, 20.0), line(1, 0, "Body line of at least five words", 9.0, 200.0), line(1, 1, " second body line with six words ", 9.04, 215.0),
        line(2, 0, "legend", 8.0, 300.0), line(2, 1, "Figure 2. Caption", 9.0, 310.0), line(3, 0, "tiny", 6.0, 400.0), line(4, 0, "in the table", 9.0, 505.0),
        line(5, 0, "x", 9.0, 790.0), line(6, 0, "image", 9.0, 600.0, kind=1), line(7, 0, "Table 5 shows it all in prose", 0.0, 650.0),
    ]
    from docdelta.sources.layout import LINES, PAGES, REGIONS

    lines = spark.createDataFrame(rows, LINES)
    regions = spark.createDataFrame([("p", "v1", 0, "table", 0.0, 500.0, 600.0, 550.0)], REGIONS)
    pages = spark.createDataFrame([("p", "v1", 0, 600.0, 800.0), ("p", "v1", 1, 600.0, 800.0)], PAGES)
    got = L.extract(lines, regions, pages)
    assert got["body"].first().body_size == 9.0
    assert [r.text for r in got["blocks"].orderBy("block_ord").collect()] == ["Body line of at least five words second body line with six words", "Table 5 shows it all in prose"]
    page = {r.page_index: r for r in got["pages"].collect()}
    assert page[0].header_candidate.startswith("Body line") and page[0].footer_candidate.startswith("Table 5") and page[0].extraction_confidence == 1.0
    assert page[1].prose_text == "" and page[1].extraction_confidence == 0.0 and page[1].displayed_page_number == "2"
