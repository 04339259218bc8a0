"""Scoring of rows as their files arrive: the batch functions, fed by a file stream.

Scoring is row-local and needs no state; a checkpoint folder makes the output exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery


def score_files(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame],
                sink: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Process every parquet file of ``source`` not seen before, append the result to ``sink``, then stop."""
    rows = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source))
    return (transform(rows).writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
