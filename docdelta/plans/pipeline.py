"""The whole comparison: layout or texts in, alignments and edits out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.operators import diff, layout, match, report, sections
from docdelta.sources import layout as sources
from docdelta.sources.sinks import write_artifacts
from docdelta.sources.tables import written


@dataclass
class ComparisonResult:
    """Tables of a comparison of many pairs, and seconds by stage."""

    old_sections: DataFrame
    new_sections: DataFrame
    matches: DataFrame
    changes: DataFrame
    revision_entries: DataFrame
    pages: DataFrame | None = None
    metadata: DataFrame | None = None
    outline: DataFrame | None = None
    log: DataFrame | None = None
    timings: dict[str, float] = field(default_factory=dict)

    @property
    def kpi_summary(self) -> dict[str, int]:
        return report.kpi_summary(self.changes).first().asDict()


def _structure(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Sections of all documents of a layout dump or of plain texts."""
    entries = layout.outline(tables["bookmarks"])
    if "prose_text" in tables["pages"].columns:
        from docdelta.functions.text import normalize_text

        pages = tables["pages"].withColumn("normalized_text", normalize_text(F.col("prose_text")))
        return {"sections": sections.pattern_sections(pages), "pages": pages}
    found = layout.extract(tables["lines"], tables["regions"], tables["pages"])
    return {"sections": sections.build(entries, found["blocks"], found["pages"], found["body"]), "pages": found["pages"]}


class Comparison:
    """Compares the v1 and v2 documents of every pair. Each stage can be replaced by a function of the same form."""

    def __init__(
        self,
        structure: Callable = _structure,
        matcher: Callable = match.match_sections,
        differ: Callable = diff.diff,
        summarizer: Callable = report.summarize,
        client: Callable | None = None,
    ) -> None:
        self.structure, self.matcher, self.differ, self.summarizer, self.client = structure, matcher, differ, summarizer, client

    def compare(
        self, tables: dict[str, DataFrame] | Callable[[], dict[str, DataFrame]], output: str | None = None, progress: Callable[[str], None] | None = None, debug: bool = False
    ) -> ComparisonResult:
        """``tables`` are those of ``sources.layout``, or what a function gives that extracts them. Each stage is written to the shared folder as it ends, for the next one and whoever reads the result.

        ``output`` names a folder for artifacts; ``progress`` is told of the stages.
        """
        say, timings, began = progress or (lambda message: None), {}, time.perf_counter()

        def stage(name: str, message: str, make: Callable[[], DataFrame]) -> DataFrame:
            say(message)
            start = time.perf_counter()
            df = written(make(), name)
            timings[name] = time.perf_counter() - start
            return df

        if callable(tables):
            say("Extracting documents...")
            start = time.perf_counter()
            tables = tables()
            timings["extraction"] = time.perf_counter() - start
        structured: dict[str, DataFrame] = {}

        def structure() -> DataFrame:
            structured.update(self.structure(tables))
            return structured["sections"]

        every = stage("structuring", "Structuring sections...", structure)
        old, new = every.where("side = 'v1'"), every.where("side = 'v2'")
        matches = stage("matching", "Matching sections...", lambda: self.matcher(old, new))
        edits = stage("diffing", "Comparing changed sections...", lambda: self.differ(matches, old, new))
        changes = stage("summarizing", "Summarizing changes...", lambda: self.summarizer(edits, self.client) if self.client else self.summarizer(edits))
        metadata = sources.document_metadata(tables["metadata"]) if "metadata" in tables else None
        entries = layout.outline(tables["bookmarks"]) if "bookmarks" in tables else None
        result = ComparisonResult(old, new, matches, changes, report.revision_entries(changes), structured.get("pages"), metadata, entries, tables.get("log"), timings)
        say("Writing report..." if output else "Finalizing...")
        start = time.perf_counter()
        if output:
            write_artifacts(result, output, debug)
        timings["reporting"] = time.perf_counter() - start
        timings["total"] = time.perf_counter() - began
        return result


class Engine:
    """The stable entry point: ``Engine(spark).compare(tables)`` or ``compare_texts``, ``compare_pdfs``."""

    def __init__(self, spark: SparkSession, client: Callable | None = None) -> None:
        self.spark, self.comparison = spark, Comparison(client=client)

    def compare(self, tables: dict[str, DataFrame], output: str | None = None, progress=None, debug: bool = False) -> ComparisonResult:
        return self.comparison.compare(tables, output, progress, debug)

    def compare_texts(self, texts: DataFrame, output: str | None = None, progress=None) -> ComparisonResult:
        """``texts``: pair_id, side ('v1' or 'v2'), text."""
        return self.compare(sources.from_texts(texts), output, progress)

    def compare_pdfs(self, pdf_v1: str, pdf_v2: str, output: str | None = None, progress=None, debug: bool = False) -> ComparisonResult:
        pairs = self.spark.createDataFrame([("pair", "v1", pdf_v1), ("pair", "v2", pdf_v2)], "pair_id string, side string, path string")
        return self.comparison.compare(lambda: sources.read_pdfs(self.spark, pairs), output, progress, debug)
