"""Posts as a stream.

Nothing here is a new operator: cleaning, tokenising, inline lexicon matching and
scoring with a loaded model look at one row at a time, so the same functions take
a streaming frame. Only the reader and the writer differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from postlab.sources.posts import NULL_MARK, POSTS


def stream_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated post files as they arrive in a folder."""
    return (
        spark.readStream.schema(POSTS)
        # Columns are taken by place, so a file with another header fails.
        .option("sep", "\t").option("header", True).option("enforceSchema", False)
        .option("quote", '"').option("escape", '"').option("multiLine", True)
        .option("nullValue", NULL_MARK).option("emptyValue", "")
        .csv(folder))


def write_available(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, exactly once, and stop."""
    return (df.writeStream.format("parquet").outputMode("append")
            .option("path", target).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
