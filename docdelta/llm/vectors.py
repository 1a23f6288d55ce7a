"""Sums of large vectors over partitions, as a tree of Spark stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def summed(df: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int, fan_in: int = 8) -> np.ndarray:
    """The float64 vector that ``add`` accumulates over all batches of ``df``.

    Every partition yields one vector of ``size``; they are then summed by
    ``fan_in`` at a time on the executors, so that no task reads more than
    about ``fan_in`` of them and the driver gets one.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                add(batch, total)
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size), False
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_py(), np.float64)
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = df.rdd.getNumPartitions()
    df = df.mapInArrow(first, "v binary")
    while parts > 1:
        parts = -(-parts // fan_in)
        df = df.repartition(parts).mapInArrow(more, "v binary")
    out = np.zeros(size)
    for row in df.collect():
        out += np.frombuffer(row[0], np.float64)
    return out
