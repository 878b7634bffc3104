"""Where pages come from: lists of URLs, CSV plans, tables of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U

OPTIONAL = ["selector", "start_marker", "end_marker"]
MOST_URLS = 200


class InputError(ValueError):
    pass


def url_list(spark: SparkSession, urls: list[str]) -> DataFrame:
    """A plan from URLs in order; repeated ones stay."""
    return spark.createDataFrame([(k, u, None, None, None) for k, u in enumerate(urls)], "input_idx bigint, url string, selector string, start_marker string, end_marker string")


def with_nulls(rows: DataFrame) -> DataFrame:
    """Empty optional fields as null, missing ones too; other columns go."""
    return rows.select("input_idx", "url", *(F.nullif(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in OPTIONAL))


def csv_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan from a UTF-8 CSV file with a header that has `url`; rows keep the file's order."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, quote='"', escape='"', nullValue=None, emptyValue="")
    if "url" not in rows.columns:
        if rows.isEmpty():
            return url_list(spark, [])
        raise InputError("CSV must have a 'url' column")
    return with_nulls(rows.withColumn("input_idx", F.monotonically_increasing_id()))


def load_plan(spark: SparkSession, inputs: list[str]) -> DataFrame:
    return csv_plan(spark, inputs[0]) if len(inputs) == 1 and inputs[0].lower().endswith(".csv") else url_list(spark, inputs)


def check_plan(plan: DataFrame, most: int | None = MOST_URLS) -> None:
    """Raises InputError for too few or too many URLs, or for the first one that is not acceptable."""
    n = plan.count()
    if n < 2:
        raise InputError("Need at least 2 URLs")
    if most is not None and n > most:
        raise InputError(f"At most {most} URLs, got {n}")
    bad = plan.select("input_idx", "url", U.problem(F.col("url")).alias("why")).where("why is not null").orderBy("input_idx").first()
    if bad:
        raise InputError(f"Invalid URL '{bad.url}': {bad.why}")


def page_table(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html of fetched pages in Parquet."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def pages_from_snapshot(snapshot: DataFrame) -> DataFrame:
    """Pages with the defaults of fields that a snapshot may lack: empty text and no blocks rather than nulls."""
    defaults = {"main_content": F.lit(""), "sha256": F.lit(""), "main_content_length": F.lit(0), "block_count": F.lit(0), "word_count": F.lit(0), "has_cjk": F.lit(False), "extraction_confident": F.lit(False), "blocks": F.array().cast("array<string>")}
    return snapshot.withColumns({c: F.coalesce(F.col(c), d) if c in snapshot.columns else d for c, d in defaults.items()})
