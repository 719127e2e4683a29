"""Frames that arrive continuously are prepared and delivered in micro-batches.

The original keeps one producer process and a bounded queue in front of a trainer.
Structured Streaming supplies both: the source is read no faster than batches are
consumed, and the checkpoint makes a restarted job continue where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def deliver(
    spark: SparkSession, source: str, schema: StructType, prepare: Callable[[DataFrame], DataFrame],
    target: str, checkpoint: str, files_per_batch: int = 5,
) -> StreamingQuery:
    """Prepare every new parquet file and append it under its batch number.

    A replayed batch overwrites its own folder, so delivery is exactly once.
    """
    frames = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
