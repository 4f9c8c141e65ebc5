"""Incremental ingest of assembly summaries as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.operators.catalog import new_entries
from baseloom.operators.ranking import dedupe_last
from baseloom.sources.tables import ASSEMBLY_SCHEMA


def summary_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of the JSON files that arrive in a folder, with their file."""
    return (
        spark.readStream.schema(ASSEMBLY_SCHEMA)
        .json(folder)
        .withColumn("_file", F.col("_metadata.file_path"))
        .where(F.col("accession").isNotNull())
    )


def ingest_stream(spark: SparkSession, folder: str, catalog_path: str, checkpoint: str):
    """Append accessions that the catalogue has not seen; each run takes what is new.

    A batch writes to its own folder of the catalogue with overwrite, so a
    batch that is run again after a failure replaces its own rows only.
    """

    def append(batch: DataFrame, number: int) -> None:
        rows = dedupe_last(batch, ["accession"], ["_file"]).drop("_file")
        seen = read_catalog(batch.sparkSession, catalog_path).where(F.col("batch") != number)
        fresh = new_entries(rows, seen)
        fresh.write.mode("overwrite").json(f"{catalog_path}/batch={number}")

    return (
        summary_stream(spark, folder)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_catalog(spark: SparkSession, catalog_path: str) -> DataFrame:
    """All catalogue rows so far; empty before the first batch."""
    schema = ASSEMBLY_SCHEMA + ", batch bigint"
    path = spark._jvm.org.apache.hadoop.fs.Path(catalog_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(catalog_path)
