"""Event games over a stream: coverage of event types by day, late events within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import bits


def read_events(spark: SparkSession, folder: str, schema, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; times without a zone are those of the session."""
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def reached(events: DataFrame, types: list[str], late: str = "1 day") -> DataFrame:
    """(window, user_id, m): by day and user the mask of the event types seen; state goes once the watermark has passed.

    `types` are the items in order, a game's players; events of other types don't count.
    """
    item = F.array_position(F.array(*map(F.lit, types)), F.col("event_type")).cast("int") - 1
    marked = events.withWatermark("ts", late).withColumn("item", item).where("item >= 0 and user_id is not null")
    return marked.groupBy(F.window("ts", "1 day").alias("window"), "user_id").agg(F.bit_or(bits.bit(F.col("item"))).alias("m"))


def served(masks: DataFrame) -> DataFrame:
    """(game_id, m, n), what coverage() takes, from finished (window, user_id, m) rows."""
    day = F.unix_date(F.to_date(F.col("window.start"))).cast("bigint")
    return masks.groupBy(day.alias("game_id"), "m").agg(F.count(F.lit(1)).alias("n"))


def start(masks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the masks of days that are over as Parquet, each once; `checkpoint` is in storage that all machines share."""
    return masks.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
