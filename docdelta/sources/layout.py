"""Where documents come from: layout dumps, plain texts and, if a parser is installed, PDF files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.sources.tables import written

# Fixed value: pages of a pair from which on it counts as large.
MANY_PAGES = 120

LINES = (
    "pair_id string, side string, page_index int, block_no int, line_no int, block_type int, block_x0 double, block_y0 double, "
    "x0 double, y0 double, x1 double, y1 double, text string, size double, page_height double"
)
REGIONS = "pair_id string, side string, page_index int, kind string, x0 double, y0 double, x1 double, y1 double"
PAGES = "pair_id string, side string, page_index int, page_width double, page_height double"
BOOKMARKS = "pair_id string, side string, ord int, level int, title string, page int"
WORDS = "pair_id string, side string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, word string"
METADATA = "pair_id string, side string, file_name string, page_count int, pdf_metadata map<string,string>"
TABLES = {"lines": LINES, "regions": REGIONS, "pages": PAGES, "bookmarks": BOOKMARKS, "words": WORDS, "metadata": METADATA}


class ExtractionError(RuntimeError):
    """A document that can't be read."""


def read_layout(spark: SparkSession, folder: str, format: str = "parquet") -> dict[str, DataFrame]:
    """The tables of a layout dump: <folder>/<table>, in Parquet or JSON, read with fixed schemas."""
    return {name: spark.read.schema(schema).format(format).load(f"{folder}/{name}") for name, schema in TABLES.items()}


def empty_layout(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def from_texts(texts: DataFrame, page_separator: str = "\f") -> dict[str, DataFrame]:
    """Documents without layout (pair_id, side, text): pages parted by form feeds, no outline, no blocks."""
    spark = texts.sparkSession
    out = empty_layout(spark)
    pages = texts.select("pair_id", "side", F.posexplode(F.split("text", page_separator)).alias("page_index", "prose_text"))
    out["pages"] = pages.withColumns({"page_width": F.lit(0.0), "page_height": F.lit(0.0)})
    return out


def document_metadata(metadata: DataFrame) -> DataFrame:
    """One row a document: code, title and revision from its metadata, as far as they are there."""
    first = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at("pdf_metadata", F.lit(k)), F.lit("")) for k in keys], F.lit(""))
    return metadata.select(
        "pair_id", "side", first("/Alternate_Name").alias("document_code"), first("/Document_Title", "title", "/Title").alias("title"),
        first("/Revision").alias("revision"), F.lit("").alias("publication_date"), "page_count", "file_name", "pdf_metadata",
    )


def preview(metadata: DataFrame) -> DataFrame:
    """(pair_id, side, title, page_count): the title, or the file's name."""
    rows = document_metadata(metadata)
    return rows.select("pair_id", "side", F.coalesce(F.nullif("title", F.lit("")), "file_name").alias("title"), "page_count")


def page_totals(metadata: DataFrame, least: int = MANY_PAGES) -> DataFrame:
    """(pair_id, pages_total, many_pages): pages of both documents of a pair, and whether they are worth spreading out."""
    total = F.sum(F.coalesce("page_count", F.lit(0))).cast("long")
    return metadata.groupBy("pair_id").agg(total.alias("pages_total"), (total >= least).alias("many_pages"))


def _absolute(path: Column) -> Column:
    """A path without scheme and host, from the root; relative ones start at the driver's folder."""
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit(os.getcwd() + "/"), bare))


def file_rows(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(pair_id, side, name, content): the file of each row of ``pairs``, found by its whole path."""
    paths = [r["path"] for r in pairs.select("path").distinct().toLocalIterator()]
    files = spark.read.format("binaryFile").load(paths).select(_absolute(F.col("path")).alias("place"), "content")
    wanted = pairs.select("pair_id", "side", F.substring_index("path", "/", -1).alias("name"), _absolute(F.col("path")).alias("place"))
    return wanted.join(files, "place").select("pair_id", "side", "name", "content")


def read_pdfs(spark: SparkSession, pairs: DataFrame) -> dict[str, DataFrame]:
    """Layout of PDF files: ``pairs`` has pair_id, side and path. Needs the parser PyMuPDF on every executor.

    Files are read by Spark as binary and parsed once, one a row; what was found
    is written to the shared folder, and all tables are derived from it. A file
    that can't be opened raises; what can't be read of a page is in the ``log``.
    """
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise ExtractionError("reading PDF files needs PyMuPDF; give a layout dump instead") from e
    from docdelta.sources import pdf

    bad = pairs.where(~F.lower("path").endswith(".pdf")).select("path").head()
    if bad is not None:
        raise ExtractionError(f"expected a .pdf file, got: {bad['path']}")
    parsed = written(file_rows(spark, pairs).mapInPandas(pdf.parse, pdf.PARSED), "parsed")
    broken = parsed.where("page_index < 0 AND page_count IS NULL").select("file_name", "failed").head()
    if broken is not None:
        raise ExtractionError(f"can't read {broken['file_name']}: {broken['failed'][0]}")
    return pdf.tables_of(parsed)
