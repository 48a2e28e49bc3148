"""Edges that arrive as a stream, kept as a table of the largest weight of each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refresh(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that folds batches of (src, dst, w) into versions of a table under path.

    Each batch writes version=<batch id> from the one before, so a batch that is run again after
    a failure overwrites its own version with the same rows.
    """

    def fold(batch: DataFrame, number: int) -> None:
        rows = batch.select("src", "dst", "w")
        if number > 0:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{path}/version={number - 1}"))
        rows.groupBy("src", "dst").agg(F.max("w").alias("w")).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
