"""Sequences on disk as chunks that joins need not move.

A store is two tables. ``bases`` holds the chunks, bucketed and sorted by genome, sequence and chunk number: a join on these
columns reads the buckets in place, so only the other side (intervals) is shuffled. ``sequences`` is a small dimension with the length of
each sequence, so that what is asked of sequences never scans bases.

Bases are shuffled once, when the store is written. The files lie in the shared scratch folder unless a path is given; the tables are
registered in the session's catalogue under their name. The number of buckets is fixed then: take about one per 100 to 200 MB of bases.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.session import scratch_path

CHUNK_KEY = ["genome_pk", "sequence_id", "chunk_no"]


@dataclass(frozen=True)
class ChunkStore:
    """``bases``: genome_pk, sequence_id, chunk_no, bases. ``sequences``: genome_pk, sequence_id, sequence_length, n_chunks."""

    name: str
    bases: DataFrame
    sequences: DataFrame


def write_chunk_store(chunks: DataFrame, name: str | None = None, buckets: int | None = None, path: str | None = None) -> ChunkStore:
    """Write chunks (genome_pk, sequence_id, chunk_no, bases) as a store."""
    spark = chunks.sparkSession
    name = name or f"chunks_{uuid.uuid4().hex[:12]}"
    path = path or scratch_path(spark, name)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select(*CHUNK_KEY, "bases").repartition(buckets, *CHUNK_KEY)
    rows.write.bucketBy(buckets, *CHUNK_KEY).sortBy(*CHUNK_KEY).option("path", f"{path}/bases").saveAsTable(f"{name}_bases")
    lengths = spark.table(f"{name}_bases").select(*CHUNK_KEY, F.length("bases").alias("n"))
    lengths = lengths.groupBy("genome_pk", "sequence_id").agg(
        F.sum("n").cast("bigint").alias("sequence_length"), F.count(F.lit(1)).alias("n_chunks")
    )
    lengths.write.option("path", f"{path}/sequences").saveAsTable(f"{name}_sequences")
    return open_chunk_store(spark, name)


def open_chunk_store(spark: SparkSession, name: str) -> ChunkStore:
    return ChunkStore(name, spark.table(f"{name}_bases"), spark.table(f"{name}_sequences"))


def is_whole(spark: SparkSession, store: ChunkStore) -> bool:
    """Whether both tables and their files are still there."""
    for part in ("bases", "sequences"):
        if not spark.catalog.tableExists(f"{store.name}_{part}"):
            return False
        about = spark.sql(f"DESCRIBE TABLE EXTENDED {store.name}_{part}").where("col_name = 'Location'").first()
        done = spark._jvm.org.apache.hadoop.fs.Path(about["data_type"], "_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return False
    return True


def drop_chunk_store(spark: SparkSession, name: str) -> None:
    """Take the tables out of the catalogue; files at a path of their own stay."""
    for part in ("bases", "sequences"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
