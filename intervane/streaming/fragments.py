"""Fragment files as a stream: new files are parsed and copies dropped as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervane.operators.rejects import parse_lines

LINES = "line_id BIGINT, file_name STRING, line_no INT, line_text STRING, received_at TIMESTAMP"


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Raw lines from Parquet files that appear in ``folder``."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_parsed(lines: DataFrame, files: DataFrame, chrom_sizes: DataFrame, late: str = "7 days") -> DataFrame:
    """Parsed lines, each delivery once within ``late``: the columns of the batch operator and received_at.

    Lines delivered again after that are rows again; state is dropped as the
    watermark passes. The small tables are read once per trigger.
    """
    once = lines.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["line_id", "file_name", "line_text"])
    return parse_lines(once, files, chrom_sizes)


def reject_rates(parsed_with_time: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Lines and failing lines per file and window of delivery time; late rows count until the watermark passes."""
    failing = F.col("reason").isNotNull().cast("bigint")
    return (
        parsed_with_time.withWatermark("received_at", late)
        .groupBy(F.window("received_at", window).alias("period"), "file_name")
        .agg(F.count("*").alias("n_lines"), F.sum(failing).alias("n_failing"))
    )
