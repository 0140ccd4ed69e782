"""Incremental scoring: new manifest rows arrive as files; a pair is scored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinloom.sources import MANIFEST


def new_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of manifests that appear in a folder, each pair_id once."""
    return spark.readStream.schema(MANIFEST).option("header", True).csv(folder).where("pair_id is not null").dropDuplicates(["pair_id"])


def score_stream(pairs: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and append it as JSON lines; the batch number in the path makes a repeated batch replace itself."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").json(f"{out}/batch={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
