"""The current assembly of each species, kept in stream state while summary files arrive.

Two streams, each with a checkpoint of its own:

* ``collect_rows``: files to a table of rows, one per accession. The accessions seen so far are the state of a streaming
  deduplication, so files that come twice, and accessions that come again later, add nothing.
* ``track_current``: that table to a log of the best assembly per species. The best so far and the number of assemblies are the state of
  a streaming aggregate. Rows of a species are reduced before the shuffle, so one species may hold most of a batch. A
  batch costs what it brings, not what the catalogue holds. Late files need no care: the best is a maximum.

A batch of the log is a folder that is written with overwrite, so a batch that runs again after a failure replaces itself.
``current_catalog`` and ``supersessions`` read rows and log as ordinary tables. With many species, set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, which keeps state outside the heap.

If copies of one accession differ and come in one batch, any one of them stays; of different batches, the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baseloom.functions.names import accession_root, normalize_species
from baseloom.streaming.ingest import summary_stream

ROW_SCHEMA = (
    "accession string, species_key string, organism_name string, taxon_id string, assembly_name string, "
    "assembly_level string, is_refseq boolean"
)
LOG_SCHEMA = "species_key string, accession string, n_assemblies bigint, batch bigint"


def assembly_rows(summaries: DataFrame) -> DataFrame:
    """Flat rows of summaries; without an organism the accession root stands for the species."""
    organism = F.coalesce("organism.organism_name", F.lit(""))
    info = F.col("assembly_info")
    key = F.coalesce(F.nullif(normalize_species(organism, "ncbi"), F.lit("")), accession_root(F.col("accession")))
    return summaries.where(F.trim("accession") != "").select(
        "accession",
        key.alias("species_key"),
        organism.alias("organism_name"),
        F.coalesce(F.col("organism.tax_id").cast("string"), F.lit("")).alias("taxon_id"),
        F.coalesce(info["assembly_name"], F.lit("")).alias("assembly_name"),
        F.coalesce(F.nullif(info["assembly_level"], F.lit("")), F.lit("chromosome")).alias("assembly_level"),
        F.col("accession").startswith("GCF_").alias("is_refseq"),
    )


def _preference() -> Column:
    """RefSeq first, then the highest accession, as ``current_assemblies`` has it."""
    return F.max(F.struct(F.col("is_refseq").cast("int").alias("r"), F.col("accession").alias("a")))


def collect_rows(spark: SparkSession, folder: str, rows_path: str, checkpoint: str):
    """Start: files of a folder to the table of rows; ends when all files there have been taken."""
    return (
        assembly_rows(summary_stream(spark, folder))
        .dropDuplicates(["accession"])
        .writeStream.format("parquet")
        .option("path", rows_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def track_current(spark: SparkSession, rows_path: str, log_path: str, checkpoint: str):
    """Start: rows to the log of best assemblies; each batch logs the species it touched."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    best = (
        spark.readStream.schema(ROW_SCHEMA)
        .parquet(rows_path)
        .groupBy("species_key")
        .agg(_preference().alias("best"), F.count(F.lit(1)).alias("n_assemblies"))
        .select("species_key", F.col("best.a").alias("accession"), "n_assemblies")
    )
    return (
        best.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_once(spark: SparkSession, folder: str, store: str) -> None:
    """Take what is new in ``folder`` through both streams; ``store`` holds rows, log and checkpoints."""
    collect_rows(spark, folder, f"{store}/rows", f"{store}/rows-progress").awaitTermination()
    track_current(spark, f"{store}/rows", f"{store}/log", f"{store}/log-progress").awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_rows(spark: SparkSession, store: str) -> DataFrame:
    path = f"{store}/rows"
    return spark.read.schema(ROW_SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], ROW_SCHEMA)


def read_log(spark: SparkSession, store: str) -> DataFrame:
    path = f"{store}/log"
    return spark.read.schema(LOG_SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LOG_SCHEMA)


def current_catalog(spark: SparkSession, store: str) -> DataFrame:
    """All rows with ``is_current_for_species`` and ``replaced_by_accession`` as of the last batch."""
    last = read_log(spark, store).groupBy("species_key").agg(F.max(F.struct("batch", "accession"))["accession"].alias("_best"))
    current = F.col("accession") == F.col("_best")
    return (
        read_rows(spark, store)
        .join(last, "species_key")
        .withColumn("is_current_for_species", current)
        .withColumn("replaced_by_accession", F.when(current, F.lit("")).otherwise(F.col("_best")))
        .drop("_best")
    )


def supersessions(spark: SparkSession, store: str) -> DataFrame:
    """One event per batch and species whose current assembly changed: batch, species_key, old_accession, new_accession, n_superseded.

    ``n_superseded`` is the number of the species' other assemblies at that time. A species has one log row per batch that
    touched it, so no window is larger than the number of batches.
    """
    order = Window.partitionBy("species_key").orderBy("batch")
    before = F.lag("accession").over(order)
    return (
        read_log(spark, store)
        .withColumn("old_accession", before)
        .where("old_accession <> accession")
        .select("batch", "species_key", "old_accession", F.col("accession").alias("new_accession"), (F.col("n_assemblies") - 1).alias("n_superseded"))
    )
