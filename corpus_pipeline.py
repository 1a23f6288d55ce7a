"""A corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes all that the one before it kept; all but the last return the
columns of ``documents``. A stage's result is to be written before the next
one is called, which begins by removing what its predecessor left behind.
"""

from __future__ import annotations

import re
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm import langid, mixing, packing, pii, simhash
from docdelta.llm.common import fresh, materialize, table
from docdelta.sources.tables import drop_paths, drop_since, made_since, mark

#: Folders that the last stage called left behind, by application.
_LEFT: dict[str, list[str]] = {}


def _tidy(stage):
    """The stage, after the removal of what the one before it left (unless ``docs`` still reads that)."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app, bare = spark.sparkContext.applicationId, lambda p: re.sub("^[a-z0-9]+:(//[^/]*)?", "", p)
        if left := _LEFT.pop(app, None):
            read = {bare(f).rsplit("/", 1)[0] for f in docs.inputFiles()}
            drop_paths(spark, [p for p in left if not any(f.startswith(bare(p)) for f in read)])
        since = mark(spark)
        out = stage(spark, docs, sf_dir)
        _LEFT[app] = made_since(spark, since)
        return out

    return run_stage


@_tidy
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go; a missing lang is filled in."""
    return langid.accept(docs)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


@_tidy
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates (see ``pii.pseudonymize``); n_chars follows a text that changes."""
    (count,) = fresh(docs.columns, "n_entities")
    out = pii.pseudonymize(docs, pii.session_key(spark), count_col=count)
    n_chars = F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


@_tidy
def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that meet the target domain weights."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"))


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing_rates),
    ("packing", packed),
]

#: Fingerprints, networks and token ids are beyond SQL; tests/llm/test_pipeline.py checks the run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    What a stage read and wrote on its way goes as soon as its own table is there.
    """
    docs, since = table(spark, sf_dir, "documents"), mark(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_since(spark, since, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
