"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``written`` made and nobody removed yet, by application.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    A folder of our own stands in only where driver and executors are one
    process (tests and local runs); on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docdelta-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends if not before."""
    path = f"{shared_dir(spark)}/docdelta/{what}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if not _MADE:
        atexit.register(_remove_all, spark.sparkContext._jvm)
    _MADE.setdefault(app, []).append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: later plans start from a scan, and survive lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def mark(spark: SparkSession) -> int:
    """How many folders there are by now, for ``drop_since``."""
    return len(_MADE.get(spark.sparkContext.applicationId, ()))


def made_since(spark: SparkSession, since: int) -> list[str]:
    """The folders made after ``since`` that are still there."""
    return _MADE.get(spark.sparkContext.applicationId, [])[since:]


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that ``written`` or ``new_folder`` made; plans that read them end here."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in made:
            made.remove(path)
            _remove(spark.sparkContext._jvm, path)


def drop_since(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Remove the folders made after ``since``, but for that of ``keep``; plans that read them end here."""
    made = _MADE.get(spark.sparkContext.applicationId, [])
    kept = getattr(keep, "_written_to", None)
    drop_paths(spark, [p for p in made[since:] if p != kept])


def drop(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` returned."""
    path = df._written_to
    for made in _MADE.values():
        if path in made:
            made.remove(path)
    _remove(df.sparkSession.sparkContext._jvm, path)


def _remove(jvm, path: str) -> None:
    session, found = jvm.org.apache.spark.sql.SparkSession.getDefaultSession(), jvm.org.apache.hadoop.fs.Path(path)
    conf = session.get().sparkContext().hadoopConfiguration() if session.isDefined() else jvm.org.apache.hadoop.conf.Configuration()
    found.getFileSystem(conf).delete(found, True)


def _remove_all(jvm) -> None:
    for made in _MADE.values():
        for path in made:
            with contextlib.suppress(Exception):  # the process ends, and the gateway may be gone
                _remove(jvm, path)
