"""Second moments of a growing table: every micro-batch adds its sums to a stored running total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.gram import moments


def running_moments(stream: DataFrame, columns: dict[str, Column], path: str, checkpoint: str, weight: Column | None = None) -> StreamingQuery:
    """Appends each batch's moments under its batch id; a batch that is run again replaces its own sums."""

    def add(batch: DataFrame, batch_id: int) -> None:
        moments(batch, columns, weight).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_moments(df: DataFrame) -> DataFrame:
    """The sum of stored batches, a row like that of ``moments`` over all rows at once."""
    names = [c for c in df.columns if c.startswith("m") and c[1:].isdigit()]
    return df.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
