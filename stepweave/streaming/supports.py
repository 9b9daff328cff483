"""Streaming forms: pattern supports as scenarios arrive, and resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepweave.operators import sequences
from stepweave.sources.tables import append_missing


def supports(scenario_stream: DataFrame, l_max: int = sequences.L_MAX) -> DataFrame:
    """Running support of each pattern over a stream of whole scenarios (the
    columns of ``sequences.scenarios``); the state has one row per pattern."""
    return sequences.slices(scenario_stream, l_max).groupBy("pattern", "L").agg(F.count(F.lit(1)).alias("support_total"))


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append the rows whose key is not yet below ``path``, batch by batch, of
    all that has arrived; a batch that is run again after a failure adds
    nothing twice."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda rows, _: append_missing(rows, path, key)).start()
