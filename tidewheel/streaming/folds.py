"""Keyed folds over streams: asynchronous updates as Structured Streaming.

An extension: deltas arrive as a stream and the state per key is kept by Spark's
state store, recovered from its checkpoint after failures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fold_stream(deltas: DataFrame, how: Callable[[Column], Column], key: str = "key", value: str = "value") -> DataFrame:
    """The running fold of a stream of (key, value); write it in update or complete mode."""
    return deltas.groupBy(key).agg(how(F.col(value)).alias(value))


def start(folded: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Keep the state as an in-memory table of the session, for reads by name."""
    return folded.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
