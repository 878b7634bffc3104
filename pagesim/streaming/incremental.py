"""Pages as a stream: extracted as they come, and held against the history of what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract

PAGE_ROWS = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """Pages of Parquet files as they appear in a folder."""
    return spark.readStream.schema(PAGE_ROWS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def extracted(stream: DataFrame) -> DataFrame:
    """page_id, url, sha256, block_count of each page; nothing is kept between batches."""
    return extract.extract_pages(stream).select("page_id", "url", "sha256", "block_count")


def first_seen(stream: DataFrame, time: str, delay: str = "1 hour", key: str = "sha256") -> DataFrame:
    """The first row of each key; a key's state goes once the watermark has passed it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(events: DataFrame, time: str = "ts", width: str = "1 day", slide: str | None = None, delay: str = "1 hour", by: str = "event_type") -> DataFrame:
    """n and total of value for each window and kind; late rows count until the watermark passes their window."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = events.withWatermark(time, delay).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total")


def duplicate_alerts(stream: DataFrame, history: str, alerts: str, checkpoint: str) -> StreamingQuery:
    """Writes page_id, url, first_id for pages whose text an earlier page has, and adds new texts to the history.

    A batch replaces its own folder when it is tried again, so each page is told once.
    """
    spark = stream.sparkSession
    schema = "sha256 string, first_id bigint, batch bigint"

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        known = spark.read.schema(schema).option("basePath", history).parquet(history).where(F.col("batch") < number) if number and _exists(spark, history) else spark.createDataFrame([], schema)
        own = batch.groupBy("sha256").agg(F.min("page_id").alias("own_id"))
        joined = own.join(known.select("sha256", "first_id"), "sha256", "left")
        first = joined.select("sha256", F.coalesce("first_id", "own_id").alias("first_id"), F.col("first_id").isNull().alias("fresh")).persist()
        told = batch.join(first, "sha256").where("page_id <> first_id").select("page_id", "url", "first_id")
        told.write.mode("overwrite").parquet(f"{alerts}/batch={number}")
        first.where("fresh").select("sha256", "first_id").write.mode("overwrite").parquet(f"{history}/batch={number}")
        batch.unpersist()
        first.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
