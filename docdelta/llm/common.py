"""Helpers that all operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.sources.tables import drop, new_folder, written

__all__ = ["drop_materialized", "fresh", "materialize", "new_folder", "remainder", "shuffle_partitions", "table", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark alone (any file system will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs no recomputation of
    what lies before it, and the files can be read from any machine. They go
    when ``drop_materialized`` is called, or when the application ends.
    """
    return written(df, what)


def drop_materialized(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` returned."""
    drop(df)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``columns`` (case aside)."""
    held = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value of a string column; null is empty."""
    for value in column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column:
        yield value.as_py() or b""


def remainder(key, n: int):
    """crc32 of the decimal text of ``key``, modulo ``n`` (null key: of the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n
