"""A folder of law files as a stream: the same chunk expressions, each micro-batch an idempotent insert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import universal_newlines
from lexloom.operators.chunking import chunk
from lexloom.operators.store import ParquetStore


def law_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(law, text): files named LAW.txt or LAW-anything.txt."""
    rows = spark.readStream.format("text").option("wholetext", True).load(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    return rows.select(F.upper(F.split(name, "-")[0]).alias("law"), universal_newlines(F.col("value")).alias("text"))


def ingest_stream(spark: SparkSession, folder: str, store: ParquetStore, checkpoint: str):
    """Starts the query. A batch that runs twice after a failure inserts nothing twice: known chunk ids are left alone."""
    return law_stream(spark, folder).writeStream.foreachBatch(lambda df, _: store.ingest(chunk(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
