"""What a comparison leaves behind: tables, JSON and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, UTF-8, nulls left out."""
    df.write.mode("overwrite").json(path)


def write_html(reports: DataFrame, path: str) -> None:
    """Reports (pair_id, html) as text files, a folder for each pair; rows hold whole documents."""
    reports.select(F.col("pair_id").cast("string").alias("pair_id"), F.col("html").alias("value")).write.mode("overwrite").partitionBy("pair_id").text(path, lineSep="\n")


def normalized_documents(sections: DataFrame) -> DataFrame:
    """(pair_id, side, sections): each document as one row, its sections in order and without their page maps."""
    columns = ["order_index", *[c for c in sections.columns if c not in ("pair_id", "side", "order_index", "page_map")]]
    return sections.groupBy("pair_id", "side").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("sections"))


def write_artifacts(result, path: str, debug: bool = False) -> None:
    """All artifacts of a comparison; the large pages table only for debugging."""
    from docdelta.operators import report

    write_json(result.matches, f"{path}/section_matches")
    write_json(result.changes, f"{path}/diff_report")
    write_json(result.revision_entries, f"{path}/revision_history_draft")
    write_json(report.kpi_summary(result.changes, by_pair=True), f"{path}/kpi_summary")
    write_json(report.kpi_by_chapter(result.changes).drop("chapter_order"), f"{path}/kpi_by_chapter")
    write_html(report.html_reports(result.changes), f"{path}/comparison_report")
    for side, sections in (("v1", result.old_sections), ("v2", result.new_sections)):
        write_json(sections, f"{path}/{side}/section_index")
        write_json(normalized_documents(sections), f"{path}/{side}/normalized_document")
        for name, df in (("outline", result.outline), ("extract_log", result.log)):
            if df is not None:
                write_json(df.where(F.col("side") == side), f"{path}/{side}/{name}")
        if result.metadata is not None:
            write_json(result.metadata.where(F.col("side") == side), f"{path}/{side}/metadata")
        if debug and result.pages is not None:
            write_json(result.pages.where(F.col("side") == side), f"{path}/{side}/pages")
