"""Sections from outlines, from heading fonts or from numbered lines.

All builders give the same columns (``COLUMNS``), one row a section. Bodies are
arrays of (page, text) pieces in reading order; text before the first heading
belongs to no section.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType
from pyspark.sql.window import Window

from docdelta.functions import text as T
from docdelta.operators.layout import DOC
from docdelta.sources.tables import written

# Font differences in points, and heading patterns.
BODY_MAX_DELTA = 1.5
HEADING_DELTA = 0.6
NUMBER_ONLY = r"^\d+(?:\.\d+)*\.?$"
UNNUMBERED_TYPES = ["introduction", "appendix", "toc", "list_of_tables", "list_of_figures", "revision_history"]
HEADING = r"^(\d+(?:\.\d+)*)(?:[.)]?\s+)([A-Z0-9][^\n]{2,160})$"
STEP_PREFIXES = [
    "area ", "byte ", "bytes ", "choose ", "erase ", "wait for ack", "wait for nack", "if loop",
    "if not last", "if last", "not ", "only ", "perform ", "read data ", "select ", "used ",
]

COLUMNS = [
    *DOC, "section_id", "number", "title", "full_title", "level", "parent_section_id", "section_type", "page_start", "page_end", "order_index",
    "raw_text", "normalized_text", "comparison_enabled", "normalized_text_hash", "text_length", "word_count", "page_map",
]
PAGE_MAP = "array<struct<page:int,text:string>>"


def assemble_body(items: Column) -> Column:
    """array<struct<page,text>> of the pieces that keep text once noise lines are gone."""
    cleaned = F.transform(items, lambda x: F.struct(x["page"].cast("int").alias("page"), T.drop_noise_lines(x["text"]).alias("text")))
    return F.filter(cleaned, lambda x: x["text"] != "")


def echo_keys(headings: DataFrame) -> DataFrame:
    """(pair_id, side, key): keys by which running headers repeat headings (number, title)."""
    bare = F.regexp_replace("title", r"(?i)^appendix\s+[A-Za-z0-9]+\s+", "")
    both = F.when(F.col("number") != "", F.concat_ws(" ", "number", "title")).otherwise(F.col("title"))
    keys = F.transform(F.array(F.col("title"), bare, both), T.canonical_key)
    return headings.select(*DOC, F.explode(keys).alias("key")).where("length(key) >= 6").distinct()


def finish(rows: DataFrame) -> DataFrame:
    """The common columns, from number, title, section_type, level, pages, order_index, raw_text and items."""
    rows = rows.withColumn("page_map", assemble_body(F.col("items")))
    rows = rows.withColumn("normalized_text", F.array_join(F.transform("page_map", lambda x: x["text"]), "\n"))
    slug = T.slugify(F.when(F.col("number") != "", F.col("number")).otherwise(F.col("title")), F.col("order_index").cast("string"))
    rows = rows.withColumn("base", F.concat(F.lit("sec_"), slug))
    again = F.row_number().over(Window.partitionBy(*DOC, "base").orderBy("order_index")) > 1
    return rows.withColumns(
        {
            "section_id": F.when(again, F.concat_ws("_", "base", F.col("order_index").cast("string"))).otherwise(F.col("base")),
            "full_title": F.when(F.col("number") != "", T.strip(F.concat_ws(" ", "number", "title"))).otherwise(F.col("title")),
            "parent_section_id": T.parent_id(F.col("number")),
            "comparison_enabled": ~F.col("section_type").isin(T.NON_COMPARISON_TYPES) & (F.col("normalized_text") != ""),
            "normalized_text_hash": T.stable_hash(T.canonical_key(F.col("normalized_text"))),
            "text_length": F.length("normalized_text"),
            "word_count": T.word_count(F.col("normalized_text")),
        }
    ).select(*COLUMNS)


def _items(order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("page").alias("page"), F.col("text").alias("text")))), lambda x: F.struct(x["page"].alias("page"), x["text"].alias("text")))


def _empty_items() -> Column:
    return F.array().cast(PAGE_MAP)


def outline_anchors(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(pair_id, side, ord, start, matched): where each outline entry begins in the blocks.

    A scan over each document with a moving cursor, on keys and pages only: the
    first block from the cursor on that starts with the heading, on no earlier
    page than the one before the entry's; else the first block of its page.
    """
    heads = entries.select(*DOC, "ord", F.col("page_index").alias("page"), T.canonical_key(F.concat_ws(" ", F.nullif("number", F.lit("")), "title")).alias("key"))
    bodies = blocks.select(*DOC, "block_ord", "page_index", T.canonical_key(F.col("text")).alias("key"))

    def scan(head: pd.DataFrame, body: pd.DataFrame) -> pd.DataFrame:
        body = body.sort_values("block_ord")
        keys, pages = body["key"].tolist(), body["page_index"].tolist()
        n, cursor, out = len(keys), 0, []
        for row in head.sort_values("ord").itertuples():
            hit = None
            if len(row.key) >= 3:
                hit = next((j for j in range(cursor, n) if keys[j].startswith(row.key) and pages[j] >= row.page - 1), None)
            start = hit if hit is not None else next((j for j in range(cursor, n) if pages[j] >= row.page), n)
            cursor = start + 1 if hit is not None else max(cursor, start)
            out.append((row.pair_id, row.side, row.ord, start, hit is not None, n))
        return pd.DataFrame(out, columns=["pair_id", "side", "ord", "start", "matched", "n"])

    kind = heads.schema["pair_id"].dataType.simpleString()
    return heads.groupBy(*DOC).cogroup(bodies.groupBy(*DOC)).applyInPandas(scan, f"pair_id {kind}, side string, ord int, start int, matched boolean, n int")


def outline_sections(entries: DataFrame, blocks: DataFrame, body: DataFrame) -> DataFrame:
    """One section a bookmark; its body runs to the next bookmark's place in the block stream."""
    order = Window.partitionBy(*DOC).orderBy("ord")
    spans = outline_anchors(entries, blocks).withColumn("until", F.coalesce(F.lead("start").over(order), F.col("n"))).withColumn("since", F.col("start") + F.col("matched").cast("int"))
    owned = spans.where("until > since").select(*DOC, "ord", F.explode(F.sequence("since", F.col("until") - 1)).alias("block_ord"))
    inside = owned.join(blocks, [*DOC, "block_ord"]).join(body, DOC, "left").withColumn("body_size", F.coalesce("body_size", F.lit(0.0)))
    ends = inside.groupBy(*DOC, "ord").agg(F.max_by(F.col("page_index"), F.col("block_ord")).alias("last_page"))
    prose = inside.where((F.col("body_size") == 0) | (F.col("max_size") == 0) | (F.col("max_size") < F.col("body_size") + BODY_MAX_DELTA))
    prose = prose.withColumn("key", T.canonical_key(F.col("text"))).join(echo_keys(entries), [*DOC, "key"], "left_anti").withColumn("page", F.col("page_index") + 1)
    bodies = prose.groupBy(*DOC, "ord").agg(_items("block_ord").alias("items"))
    rows = entries.join(bodies, [*DOC, "ord"], "left").join(ends, [*DOC, "ord"], "left").withColumn("items", F.coalesce("items", _empty_items()))
    start = F.col("page_index") + 1
    return finish(
        rows.withColumns(
            {
                "page_start": start, "page_end": F.coalesce(F.lead("page_index").over(order) + 1, F.col("last_page") + 1, start), "order_index": F.col("ord"),
                "raw_text": T.strip(F.array_join(F.transform("items", lambda x: x["text"]), "\n")),
            }
        )
    )


def classify_heading(text: Column) -> Column:
    """struct<number,title,section_type> of a heading line, or null."""
    title = T.strip(F.regexp_extract(text, T.NUMBERED_TITLE, 2))
    kind = T.classify_section_type(text)
    numbered = F.when((title != "") & (T.word_count(title) <= 12) & ~title.endswith("."), F.struct(F.regexp_extract(text, T.NUMBERED_TITLE, 1).alias("number"), title.alias("title"), kind.alias("section_type")))
    plain = F.when(kind.isin(UNNUMBERED_TYPES) & (T.word_count(text) <= 8), F.struct(F.lit("").alias("number"), text.alias("title"), kind.alias("section_type")))
    return F.when(T.is_toc_line(text), None).when(text.rlike(T.NUMBERED_TITLE), numbered).otherwise(plain)


def font_sections(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """Sections whose headings are set in a larger font; a lone number joins the heading line that follows."""
    order = Window.partitionBy(*DOC).orderBy("line")
    items = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.array(F.struct(F.col("text"), F.col("max_size").alias("size"))))
    lines = blocks.select(*DOC, "page_index", "block_ord", F.posexplode(items).alias("pos", "x"))
    lines = lines.select(*DOC, (F.row_number().over(Window.partitionBy(*DOC).orderBy("block_ord", "pos")) - 1).alias("line"), "page_index", F.col("x.text").alias("text"), F.col("x.size").alias("size"))
    lines = lines.join(body, DOC, "left").withColumn("body_size", F.coalesce("body_size", F.lit(0.0)))
    stripped = T.strip(F.col("text"))
    lines = lines.withColumn("large", (F.col("size") != 0) & (F.col("size") >= F.col("body_size") + HEADING_DELTA) & ~T.is_toc_line(stripped))
    pair = F.col("large") & stripped.rlike(NUMBER_ONLY) & F.coalesce(F.lead("large").over(order), F.lit(False))
    joined = F.concat(F.regexp_replace(stripped, r"\.+$", ""), F.lit(" "), T.strip(F.lead("text").over(order)))
    lines = lines.withColumn("pair", pair).withColumn("heading", F.when(F.col("large"), classify_heading(F.when(pair, joined).otherwise(stripped))))
    lines = written(lines, "lines")  # read by headings, bodies and pages below, each of which would classify again
    # A line that a pair takes in can't begin a heading: of lines in a run of pairs, every other one does.
    lines = lines.withColumn("takes", F.col("pair") & F.col("heading").isNotNull())
    run = F.col("line") - F.max(F.when(~F.col("takes"), F.col("line"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    place = F.coalesce(run, F.col("line") + 1)
    lines = lines.withColumn("takes", F.col("takes") & (place % 2 == 1))
    lines = lines.withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False)))
    lines = lines.withColumn("starts", F.col("heading").isNotNull() & ~F.col("taken"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("at", F.last(F.when(F.col("starts"), F.col("line")), True).over(so_far))
    heads = lines.where("starts").select(*DOC, F.col("line").alias("at"), "heading.*", "page_index")
    last = lines.where("at is not null").groupBy(*DOC, "at").agg(F.max_by(F.col("page_index"), F.col("line")).alias("last_page"), F.max(F.when(~F.col("starts") & ~F.col("taken"), F.col("line"))).alias("last_body"))
    prose = lines.where("at is not null AND NOT starts AND NOT taken AND size < body_size + " + str(BODY_MAX_DELTA))
    prose = prose.withColumn("key", T.canonical_key(F.col("text"))).join(echo_keys(heads), [*DOC, "key"], "left_anti").withColumn("page", F.col("page_index") + 1)
    bodies = prose.groupBy(*DOC, "at").agg(_items("line").alias("items"))
    rows = heads.join(bodies, [*DOC, "at"], "left").join(last, [*DOC, "at"], "left").withColumn("items", F.coalesce("items", _empty_items()))
    start = F.col("page_index") + 1
    return finish(
        rows.withColumns(
            {
                "order_index": F.row_number().over(Window.partitionBy(*DOC).orderBy("at")) - 1, "page_start": start,
                "page_end": F.when(F.col("last_body").isNotNull(), F.col("last_page") + 1).otherwise(start),
                "level": F.when(F.col("number") != "", F.size(F.split("number", r"\."))).otherwise(1),
                "raw_text": T.strip(F.array_join(F.transform("items", lambda x: x["text"]), "\n")),
            }
        )
    )


def is_procedure_step(title: Column) -> Column:
    lowered = T.strip(F.lower(title))
    return lowered.rlike("^(?:" + "|".join(STEP_PREFIXES) + ")") | (lowered.endswith(".") & (T.word_count(lowered) >= 4))


def is_non_comparison_page(text: Column) -> Column:
    first = F.lower(F.coalesce(F.get(T.clean_lines(text), F.lit(0)), F.lit("")))
    return first.isin("contents", "revision history") | first.startswith("list of figures") | first.startswith("list of tables")


def _page_lines(pages: DataFrame) -> DataFrame:
    kept = pages.where(~is_non_comparison_page(F.col("normalized_text")))
    return kept.select(*DOC, "page_index", F.posexplode(F.split("normalized_text", T.BREAKS)).alias("line", "text"))


def numbered_headings(pages: DataFrame) -> DataFrame:
    """(pair_id, side, page_index, line, number, title): lines that look like numbered headings."""
    lines = _page_lines(pages).withColumn("s", T.strip(F.col("text")))
    rows = lines.where(F.col("s").rlike(HEADING)).withColumns({"number": F.regexp_extract("s", HEADING, 1), "title": F.regexp_extract("s", HEADING, 2)})
    dots = F.length("title") - F.length(F.replace("title", F.lit("."), F.lit("")))
    valid = ~F.col("number").startswith("0") & ~T.is_toc_line(F.col("s")) & ~T.is_toc_line(F.col("title")) & ~is_procedure_step(F.col("title")) & F.col("title").rlike("[A-Za-z]") & (dots < 4)
    return rows.where(valid).select(*DOC, "page_index", "line", "number", "title")


def continued(numbers: list[str]) -> list[bool]:
    """Which of a document's heading numbers, in order, continue the numbering before them."""
    tops = [int(x.split(".")[0]) for x in numbers]
    nested = ["." in x for x in numbers]
    now, keep = 0, []
    for i, top in enumerate(tops):
        if nested[i]:
            keep.append(top <= now)
            continue
        good = now == 0 or top == now + 1
        if not good and top > now + 1:
            ahead = ((nested[j], tops[j]) for j in range(i + 1, len(tops)))
            back = next((dotted for dotted, t in ahead if (dotted and t == now) or (not dotted and t >= top)), False)
            good = not back
        keep.append(good)
        now = top if good else now
    return keep


@F.pandas_udf(ArrayType(BooleanType()))
def _continued(numbers: pd.Series) -> pd.Series:
    return pd.Series([continued(list(x)) for x in numbers], dtype=object)


def hierarchy_filter(candidates: DataFrame) -> DataFrame:
    """Candidates that continue the numbering, in document order (a fold with look-ahead over each document's numbers, many documents a batch)."""
    rows = candidates.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("page_index", "line", "number", "title"))).alias("found"))
    rows = rows.withColumn("keep", _continued(F.transform("found", lambda x: x["number"])))
    kept = F.filter(F.transform("found", lambda x, i: F.struct(x.alias("x"), F.get(F.col("keep"), i).alias("keep"))), lambda y: y["keep"])
    return rows.select(*DOC, F.explode(kept).alias("y")).select(*DOC, "y.x.*")


def pattern_sections(pages: DataFrame) -> DataFrame:
    """Sections from numbered lines; a document without any is one section."""
    pages = written(pages.select(*DOC, "page_index", "normalized_text"), "pages")  # read by headings, bodies and the documents without any
    heads = written(hierarchy_filter(numbered_headings(pages)), "headings")  # read by titles, bodies and the documents without any
    order = Window.partitionBy(*DOC).orderBy("page_index", "line")
    heads = heads.withColumn("order_index", F.row_number().over(order) - 1).withColumn("next_page", F.lead("page_index").over(order))
    marks = heads.select(*DOC, "page_index", "line", "order_index")
    lines = _page_lines(pages).join(marks, [*DOC, "page_index", "line"], "left")
    lines = lines.withColumn("owner", F.last("order_index", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = lines.where("owner is not null AND order_index is null").groupBy(*DOC, F.col("owner").alias("order_index")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "line", "text"))), lambda x: x["text"]), "\n").alias("joined")
    )
    last = pages.groupBy(*DOC).agg((F.max("page_index") + 1).alias("pages_end"))
    titles = heads.groupBy(*DOC).agg(F.collect_set(T.canonical_key(F.col("title"))).alias("titles"))
    rows = heads.join(body, [*DOC, "order_index"], "left").join(last, DOC).join(titles, DOC).withColumn("raw_text", T.normalize_text(F.coalesce("joined", F.lit(""))))
    source = F.array_join(F.filter(T.clean_lines(F.col("raw_text")), lambda x: ~F.array_contains(F.col("titles"), T.canonical_key(x))), "\n")
    title = T.strip(F.col("title"))
    kind = T.plain_section_type(title)
    found = _plain(
        rows.withColumns({"source": source, "title": title, "section_type": kind, "full_title": F.concat_ws(" ", "number", title), "level": F.size(F.split("number", r"\.")), "page_start": F.col("page_index") + 1, "page_end": F.coalesce(F.col("next_page") + 1, F.col("pages_end"))})
        .withColumns({"section_id": F.concat(F.lit("sec_"), T.slugify(F.col("number"), F.col("order_index").cast("string"))), "parent_section_id": T.parent_id(F.col("number"))}),
        ~kind.isin("toc", "front_matter", "legal_notice"),
    )
    return found.unionByName(whole_document(pages.join(heads.select(*DOC).distinct(), DOC, "left_anti")))


def _plain(rows: DataFrame, compared: Column | None) -> DataFrame:
    rows = rows.withColumn("normalized_text", T.drop_noise_lines(F.col("source")))
    enabled = F.lit(True) if compared is None else compared & (F.col("normalized_text") != "")
    return rows.withColumns(
        {
            "comparison_enabled": enabled, "normalized_text_hash": T.stable_hash(T.canonical_key(F.col("normalized_text"))),
            "text_length": F.length("normalized_text"), "word_count": T.word_count(F.col("normalized_text")), "page_map": _empty_items(),
        }
    ).select(*COLUMNS)


def whole_document(pages: DataFrame) -> DataFrame:
    """One section a document, of all its pages."""
    from docdelta.operators.layout import ordered_text

    rows = pages.groupBy(*DOC).agg(ordered_text(F.col("page_index"), F.col("normalized_text"), "\n").alias("joined"), (F.max("page_index") + 1).alias("page_end"))
    text = T.normalize_text(F.col("joined"))
    return _plain(
        rows.withColumns(
            {
                "section_id": F.lit("sec_document"), "number": F.lit(""), "title": F.lit("Document"), "full_title": F.lit("Document"), "level": F.lit(1), "parent_section_id": F.lit(""),
                "section_type": F.lit("main_content"), "page_start": F.lit(1), "order_index": F.lit(0), "raw_text": text, "source": text,
            }
        ),
        None,
    )


def build(entries: DataFrame, blocks: DataFrame, pages: DataFrame, body: DataFrame, by_outline=None, by_font=None, by_pattern=None) -> DataFrame:
    """Sections of every document by the first builder that applies: outline, font, numbered lines, whole.

    Each of the three builders can be replaced by a function of the same form.
    """
    by_outline, by_font, by_pattern = by_outline or outline_sections, by_font or font_sections, by_pattern or pattern_sections
    from docdelta.operators.layout import outline_is_reliable

    reliable = outline_is_reliable(entries).where("outline_available").select(*DOC)
    outlined = by_outline(entries.join(reliable, DOC, "left_semi"), blocks.join(reliable, DOC, "left_semi"), body)
    set_larger = by_font(blocks.join(reliable, DOC, "left_anti"), body)
    left = pages.join(reliable, DOC, "left_anti").join(set_larger.select(*DOC).distinct(), DOC, "left_anti")
    left = left.withColumn("normalized_text", F.coalesce(F.nullif("prose_text", F.lit("")), "normalized_text"))
    return outlined.unionByName(set_larger).unionByName(by_pattern(left))
