"""Incremental ingestion: new pages join the inventory as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions.html import main_text, title
from tarnweave.functions.urls import site_form


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """Pages from Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def ingested(pages: DataFrame) -> DataFrame:
    """Pages as inventory rows: canonical address, title, text, digest."""
    text = main_text("html")
    return pages.select("page_id", F.coalesce(site_form("url"), F.col("url")).alias("url"), title("html").alias("title"), text.alias("text"), F.sha2(text, 256).alias("sha256"))


def run_once(pages: DataFrame, out: str, checkpoint: str) -> None:
    """Handles all files that are there and stops; the checkpoint makes the next run start after them, so each page is written once."""
    query = ingested(pages).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
