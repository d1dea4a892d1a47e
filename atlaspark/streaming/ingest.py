"""Incremental ingestion: files that arrive in a folder become documents exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import parse_files


def stream_files(spark: SparkSession, path: str, schema: str = "file_id BIGINT, map_id INT, path STRING, name STRING, text STRING, meta STRING, modified TIMESTAMP, ingested_at TIMESTAMP") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def fresh_documents(files: DataFrame, late: str = "180 days") -> DataFrame:
    """Parsed documents of a stream of source files: a file written twice comes out once, however far apart within the watermark its copies arrive."""
    once = files.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["file_id"])
    return parse_files(once).where("skip is null")


def arrivals(files: DataFrame, width: str = "30 days", late: str = "60 days") -> DataFrame:
    """(window, map_id, files): arrivals per map and period, closed when the watermark has passed."""
    return files.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", width), "map_id").agg(F.count("*").alias("files"))


def run_into(docs: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a Parquet table and stops when all that is there has been read."""
    return docs.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
