"""Body text from page layout: geometry filters, body font, blocks and pages.

Lines: pair_id, side, page_index, block_no, line_no, block_type, block_x0,
block_y0, x0, y0, x1, y1, text, size, page_height. Regions: pair_id, side,
page_index, kind, x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docdelta.functions.text import WS, clean_lines, normalize_text, strip, word_count

# Thresholds as parts of the page height, points or words.
HEADER_BAND, FOOTER_BAND = 0.105, 0.955
TINY_FONT = 7.5
GAP_RATIO = 0.2
REGION_MARGIN = 3.0
CLUSTER_GAP, CLUSTER_AREA = 12.0, 1500.0
SUBBODY_DELTA, ORPHAN_WORDS = 0.4, 6
CAPTION = r"(?i)^\s*(figure|table)\s+\d+\s*[.:–—-]"

DOC = ["pair_id", "side"]


def ordered_text(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: texts joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def spaced_text(chars: Column) -> Column:
    """Text of one line from its array of characters in order (c, x0, x1, size), with lost spaces put back (see ``reconstruct_lines``)."""
    space = lambda c: c.rlike(f"^{WS}+$")

    def piece(x: Column, i: Column) -> Column:
        before = F.get(chars, i - 1)
        gap = (x["size"] != 0) & (x["x0"] - before["x1"] > GAP_RATIO * x["size"]) & ~space(x["c"]) & ~space(before["c"])
        return F.when(F.coalesce(gap, F.lit(False)), F.concat(F.lit(" "), x["c"])).otherwise(x["c"])

    return F.array_join(F.transform(chars, piece), "")


def reconstruct_lines(chars: DataFrame, line: list[str]) -> DataFrame:
    """Text of each line from its characters (c, x0, x1, size; order char_no), with lost spaces put back.

    A span without character positions is one row whose c is its whole text and whose x0 is null.
    """
    window = Window.partitionBy(*line).orderBy("char_no")
    space = lambda c: c.rlike(f"^{WS}+$")
    rows = chars.where("c <> ''").withColumns({"prev_c": F.lag("c").over(window), "prev_x1": F.lag("x1").over(window)})
    gap = (F.col("size") != 0) & (F.col("x0") - F.col("prev_x1") > GAP_RATIO * F.col("size")) & ~space(F.col("c")) & ~space(F.col("prev_c"))
    piece = F.when(F.coalesce(gap, F.lit(False)), F.concat(F.lit(" "), F.col("c"))).otherwise(F.col("c"))
    return rows.groupBy(*line).agg(ordered_text(F.col("char_no"), piece, "").alias("text"))


def in_bands(lines: DataFrame) -> DataFrame:
    """Lines outside the running header and footer."""
    return lines.where((F.col("y1") > HEADER_BAND * F.col("page_height")) & (F.col("y0") < FOOTER_BAND * F.col("page_height")))


def text_blocks(lines: DataFrame) -> DataFrame:
    return lines.where("block_type = 0")


def without_captions(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("text").rlike(CAPTION))


def without_tiny(lines: DataFrame) -> DataFrame:
    """Lines with text, in a legible font; size 0 is unknown and stays."""
    return lines.where((F.col("text") != "") & ((F.col("size") == 0) | (F.col("size") >= TINY_FONT)))


def outside_regions(lines: DataFrame, regions: DataFrame, margin: float = REGION_MARGIN) -> DataFrame:
    """Lines whose centre lies in no region of their page (bounds included)."""
    keys = [*DOC, "page_index"]
    cx, cy = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    inside = cx.between(F.col("r.x0") - margin, F.col("r.x1") + margin) & cy.between(F.col("r.y0") - margin, F.col("r.y1") + margin)
    return lines.alias("l").join(regions.alias("r"), same[0] & same[1] & same[2] & inside, "left_anti")


def candidate_lines(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Body lines by geometry, with size rounded to a tenth and their number of words.

    Rounding is half-even on the decimal form of the size.
    """
    kept = outside_regions(in_bands(text_blocks(lines)), regions).withColumn("text", strip(F.col("text")))
    kept = without_tiny(without_captions(kept))
    return kept.withColumn("size", F.bround("size", 1)).withColumn("words", word_count(F.col("text")))


def dominant_body_size(lines: DataFrame) -> DataFrame:
    """(pair_id, side, body_size): the size with most words in lines of five or more; the first seen wins ties."""
    order = F.struct("page_index", "block_no", "line_no")
    sizes = lines.where("words >= 5 AND size <> 0").groupBy(*DOC, "size").agg(F.sum("words").alias("w"), F.min(order).alias("first"))
    top = Window.partitionBy(*DOC).orderBy(F.desc("w"), "first")
    return sizes.withColumn("r", F.row_number().over(top)).where("r = 1").select(*DOC, F.col("size").alias("body_size"))


def without_orphans(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Lines that are no short labels below the body size; adds body_size (0 if unknown)."""
    joined = lines.join(body, DOC, "left").withColumn("body_size", F.coalesce("body_size", F.lit(0.0)))
    orphan = (F.col("body_size") != 0) & (F.col("size") != 0) & (F.col("size") < F.col("body_size") - SUBBODY_DELTA) & (F.col("words") <= ORPHAN_WORDS)
    return joined.where(~orphan)


def assemble_blocks(lines: DataFrame) -> DataFrame:
    """Blocks in reading order: text, max_size, lines array<struct<text,size>>, block_ord from 0."""
    blocks = lines.groupBy(*DOC, "page_index", "block_no").agg(
        F.first("block_x0").alias("x0"), F.first("block_y0").alias("y0"), ordered_text(F.col("line_no"), F.col("text"), " ").alias("text"),
        F.max("size").alias("max_size"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text", "size"))), lambda x: F.struct(x["text"].alias("text"), x["size"].alias("size"))).alias("lines"),
    )
    order = Window.partitionBy(*DOC).orderBy("page_index", "block_no")
    return blocks.withColumn("block_ord", F.row_number().over(order) - 1)


def assemble_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row a page of ``pages`` (pair_id, side, page_index, ...), with its prose and what derives from it."""
    text = blocks.groupBy(*DOC, "page_index").agg(ordered_text(F.col("block_no"), F.col("text"), "\n").alias("prose_text"))
    joined = pages.join(text, [*DOC, "page_index"], "left").withColumn("prose_text", F.coalesce("prose_text", F.lit("")))
    lines = clean_lines(F.col("prose_text"))
    return joined.withColumns(
        {
            "displayed_page_number": (F.col("page_index") + 1).cast("string"),
            "normalized_text": normalize_text(F.col("prose_text")),
            "header_candidate": F.coalesce(F.get(lines, F.lit(0)), F.lit("")),
            "footer_candidate": F.when(F.size(lines) > 1, F.element_at(lines, -1)).otherwise(""),
            "extraction_confidence": F.when(strip(F.col("prose_text")) != "", 1.0).otherwise(0.0),
        }
    )


def cluster_rects(rects: Column, gap: float = CLUSTER_GAP, least_area: float = CLUSTER_AREA) -> Column:
    """Figure-sized clusters of an ordered array<struct<x0,y0,x1,y1>>.

    A rectangle joins the first cluster that it meets when grown by ``gap``;
    clusters that come to touch later stay apart.
    """
    names = ("x0", "y0", "x1", "y1")

    def united(c: Column, r: Column) -> Column:
        return F.struct(F.least(c["x0"], r["x0"]).alias("x0"), F.least(c["y0"], r["y0"]).alias("y0"), F.greatest(c["x1"], r["x1"]).alias("x1"), F.greatest(c["y1"], r["y1"]).alias("y1"))

    def meets(c: Column, r: Column) -> Column:
        return (F.least(c["x1"], r["x1"] + gap) > F.greatest(c["x0"], r["x0"] - gap)) & (F.least(c["y1"], r["y1"] + gap) > F.greatest(c["y0"], r["y0"] - gap))

    def step(clusters: Column, r: Column) -> Column:
        hit = F.array_position(F.transform(clusters, lambda c: meets(c, r)), True)
        grown = F.transform(clusters, lambda c, i: F.when(i == hit - 1, united(c, r)).otherwise(c))
        return F.when(hit > 0, grown).otherwise(F.concat(clusters, F.array(r)))

    typed = F.transform(rects, lambda r: F.struct(*[r[n].cast("double").alias(n) for n in names]))
    solid = F.filter(typed, lambda r: (r["x0"] < r["x1"]) & (r["y0"] < r["y1"]))
    start = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return F.filter(F.aggregate(solid, start, step), lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"]) >= least_area)


def extract(lines: DataFrame, regions: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """blocks, pages and body sizes of all documents, from their raw layout."""
    candidates = candidate_lines(lines, regions)
    body = dominant_body_size(candidates)
    blocks = assemble_blocks(without_orphans(candidates, body))
    return {"blocks": blocks, "pages": assemble_pages(pages, blocks), "body": body}


def outline(bookmarks: DataFrame) -> DataFrame:
    """Outline entries from bookmarks (pair_id, side, ord, level, title, page from 1); blank titles go."""
    from docdelta.functions.text import classify_section_type, split_number

    rows = bookmarks.withColumn("title", strip(F.coalesce("title", F.lit("")))).where("title <> ''")
    order = Window.partitionBy(*DOC).orderBy("ord")
    parts = split_number(F.col("title"))
    return rows.select(
        *DOC, (F.row_number().over(order) - 1).alias("ord"), F.col("level").cast("int").alias("level"), parts["number"].alias("number"), parts["title"].alias("title"),
        classify_section_type(F.col("title")).alias("section_type"), F.greatest(F.col("page").cast("int") - 1, F.lit(0)).alias("page_index"),
    )


def outline_is_reliable(entries: DataFrame) -> DataFrame:
    """(pair_id, side, outline_available): at least three numbered entries."""
    return entries.groupBy(*DOC).agg((F.count_if(F.col("number") != "") >= 3).alias("outline_available"))
