"""Raw rows of PDF files by PyMuPDF (optional, imported on the executors).

A file is parsed once: a row for the document and a row for each page, with
what the parser finds as arrays. Lines, clusters and regions are derived from
them by the layout operators, like those of any other source. A part of a page
that can't be read is left empty and named in ``failed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdelta.functions.text import let
from docdelta.operators.layout import DOC, cluster_rects, spaced_text

BOX = "x0: double, y0: double, x1: double, y1: double"
PARSED = (
    "pair_id string, side string, file_name string, page_index int, page_width double, page_height double, page_count int, metadata map<string,string>, "
    "bookmarks array<struct<level: int, title: string, page: int>>, "
    f"chars array<struct<block_no: int, line_no: int, char_no: int, block_type: int, block_x0: double, block_y0: double, {BOX}, c: string, c_x0: double, c_x1: double, size: double>>, "
    f"drawings array<struct<{BOX}>>, images array<struct<{BOX}>>, tables array<struct<{BOX}>>, words array<struct<{BOX}, word: string>>, failed array<string>"
)
NAMES = ["pair_id", "side", "file_name", "page_index", "page_width", "page_height", "page_count", "metadata", "bookmarks", "chars", "drawings", "images", "tables", "words", "failed"]


def _box(rect) -> dict[str, float]:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, rect), strict=True))


def _chars(blocks: list[dict]) -> Iterator[dict]:
    """Characters in reading order; a span without any is one entry without a left edge."""
    for b, block in enumerate(blocks):
        place = {"block_no": b, "block_type": int(block["type"]), "block_x0": float(block["bbox"][0]), "block_y0": float(block["bbox"][1])}
        for n, line in enumerate(block.get("lines", ())):
            entries = []
            for span in line["spans"]:
                size = float(span.get("size") or 0.0)
                if span.get("chars"):
                    entries += [(x["c"], float(x["bbox"][0]), float(x["bbox"][2]), size) for x in span["chars"]]
                else:
                    entries.append((span.get("text") or "", None, float(span["bbox"][2]), size))
            for k, (c, left, right, size) in enumerate(entries):
                yield {**place, "line_no": n, "char_no": k, **_box(line["bbox"]), "c": c, "c_x0": left, "c_x1": right, "size": size}


def page_row(page, number: int) -> dict:
    """What one page holds. Tables are looked for only beside drawings or images."""
    failed: list[str] = []

    def attempt(what: str, read):
        try:
            return read()
        except Exception as e:  # parsers fail in many ways on broken pages
            failed.append(f"page {number + 1}: {what}: {type(e).__name__}: {e}")
            return []

    blocks = attempt("text", lambda: page.get_text("rawdict")["blocks"])
    drawings = attempt("drawings", lambda: [_box(d["rect"]) for d in page.get_drawings() if d.get("rect")])
    images = [_box(b["bbox"]) for b in blocks if b["type"] == 1]
    return {
        "page_index": number, "page_width": float(page.rect.width), "page_height": float(page.rect.height), "chars": attempt("characters", lambda: list(_chars(blocks))),
        "drawings": drawings, "images": images, "tables": attempt("tables", lambda: [_box(t.bbox) for t in page.find_tables().tables]) if drawings or images else [],
        "words": attempt("words", lambda: [{**_box(w[:4]), "word": w[4]} for w in page.get_text("words")]), "failed": failed,
    }


def document_rows(doc) -> Iterator[dict]:
    """The document's own row (page_index -1), then its pages, as dicts of the columns that they have."""
    try:
        marks = [{"level": int(level), "title": title, "page": int(page)} for level, title, page in doc.get_toc(simple=True)]
    except Exception:  # no outline is like an empty one
        marks = []
    metadata = {str(k): str(v) for k, v in (doc.metadata or {}).items() if v}
    yield {"page_index": -1, "page_count": int(doc.page_count), "metadata": metadata, "bookmarks": marks, "failed": []}
    for number in range(doc.page_count):
        try:
            row = page_row(doc[number], number)
        except Exception as e:
            row = {"page_index": number, "page_width": 0.0, "page_height": 0.0, "failed": [f"page {number + 1}: {type(e).__name__}: {e}"]}
        yield row


def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: rows of ``PARSED`` from (pair_id, side, name, content). A file that can't be opened gives one row without a page count."""
    import fitz

    for batch in batches:
        for file in batch.itertuples():
            key = {"pair_id": file.pair_id, "side": file.side, "file_name": file.name}
            try:
                with fitz.open(stream=file.content, filetype="pdf") as doc:
                    for row in document_rows(doc):
                        yield pd.DataFrame([{name: {**key, **row}.get(name) for name in NAMES}])
            except Exception as e:
                yield pd.DataFrame([{name: {**key, "page_index": -1, "failed": [f"{type(e).__name__}: {e}"]}.get(name) for name in NAMES}])


def lines_of(chars: Column) -> Column:
    """Lines of a page, in order, from its characters: a character's place and box, its line's text and largest size."""
    shape = ["block_no", "line_no", "block_type", "block_x0", "block_y0", "x0", "y0", "x1", "y1"]

    def line(row: Column) -> Column:
        texts = F.transform(F.filter(row, lambda x: x["c"] != ""), lambda x: F.struct(x["c"].alias("c"), x["c_x0"].alias("x0"), x["c_x1"].alias("x1"), x["size"].alias("size")))
        return F.struct(*[row[0][n].alias(n) for n in shape], let(texts, spaced_text).alias("text"), F.array_max(F.transform(row, lambda x: x["size"])).alias("size"))

    def cut(every: Column) -> Column:
        begins = lambda i: (i == 0) | (F.get(every, i)["block_no"] != F.get(every, i - 1)["block_no"]) | (F.get(every, i)["line_no"] != F.get(every, i - 1)["line_no"])
        starts = F.filter(F.sequence(F.lit(0), F.size(every) - 1), begins)
        return let(starts, lambda at: F.transform(at, lambda s, k: line_at(every, s, F.coalesce(F.get(at, k + 1), F.size(every)))))

    def line_at(every: Column, start: Column, until: Column) -> Column:
        return let(F.slice(every, start + 1, until - start), line)

    # The first fields of a character are its block, line and number.
    return F.when(F.size(chars) > 0, let(F.array_sort(chars), cut))


def tables_of(parsed: DataFrame) -> dict[str, DataFrame]:
    """The layout tables (see ``sources.layout``) and a log (pair_id, side, page_index, message) of parsed files."""
    documents, pages = parsed.where("page_index < 0"), parsed.where("page_index >= 0")
    per_page = [*DOC, "page_index"]
    # A page's lines are made in its row: rows of characters would be shuffled, many times the size of the text.
    lines = pages.select(*per_page, "page_height", F.explode(lines_of(F.col("chars"))).alias("x")).select(*per_page, "page_height", "x.*")
    listed = lambda kind, boxes: pages.select(*per_page, F.lit(kind).alias("kind"), F.explode(boxes).alias("b")).select(*per_page, "kind", "b.*")
    return {
        "lines": lines.select(*per_page, "block_no", "line_no", "block_type", "block_x0", "block_y0", "x0", "y0", "x1", "y1", "text", "size", "page_height"),
        "regions": listed("table", F.col("tables")).unionByName(listed("figure", F.concat("images", cluster_rects(F.col("drawings"))))),
        "pages": pages.select(*per_page, "page_width", "page_height"),
        "bookmarks": documents.select(*DOC, F.posexplode("bookmarks").alias("ord", "b")).select(*DOC, "ord", "b.level", "b.title", "b.page"),
        "words": pages.select(*per_page, F.posexplode("words").alias("word_no", "w")).select(*DOC, (F.col("page_index") + 1).alias("page"), "word_no", "w.*"),
        "metadata": documents.select(*DOC, "file_name", "page_count", F.col("metadata").alias("pdf_metadata")),
        "log": parsed.select(*DOC, "page_index", F.explode("failed").alias("message")),
    }
