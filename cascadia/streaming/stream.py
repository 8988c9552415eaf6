"""A feature plan over a stream: the same stateless plan on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_on_stream(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes each batch's result to a folder of its own, so that a batch that is run again replaces its earlier try."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
