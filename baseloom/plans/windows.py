"""Window tables of a set of genomes, written once and summarised from there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baseloom.operators import windows as W
from baseloom.sources.sinks import write_chunks

# Default window sizes, and the columns of the chunked tables.
DEFAULT_SIZES = [300_000, 100_000, 20_000, 5_000]
WINDOW_COLUMNS = [
    "genome_pk",
    "sequence_pk",
    "window_rank",
    "start_bp",
    "end_bp",
    "mid_bp",
    "standard_window_size_bp",
    "step_size_bp",
    "width_actual_bp",
    "a_count",
    "c_count",
    "g_count",
    "t_count",
    "n_count",
    "other_count",
    "callable_bp",
    "gc_bp",
    "gc_prop",
    "callable_frac",
    "masked_bp",
    "gap_bp",
    "keep_flag",
]


def window_tables(
    chunks: DataFrame,
    sequences: DataFrame,
    genomes: DataFrame,
    path: str,
    sizes: list[int] | None = None,
    steps: list[int] | None = None,
    types: list[str] | None = None,
    chunk_bp: int = 300_000,
    min_callable: float = 0.8,
) -> dict[str, DataFrame]:
    """Windows, sequence and genome summaries, whole-sequence GC, type audit input.

    The bases are read once: the window table is written to ``path`` (split by
    size, so that one size can be read alone) and all else starts from it.
    """
    sizes = sizes or DEFAULT_SIZES
    chosen = W.filter_sequence_types(sequences, types) if types else sequences
    used = chunks.join(chosen.select("genome_pk", "sequence_pk"), ["genome_pk", "sequence_pk"], "left_semi") if types else chunks
    tiled = W.tile_windows(used, sizes, steps, min_callable=min_callable, chunk_bp=chunk_bp)
    tiled.select(*WINDOW_COLUMNS).write.partitionBy("standard_window_size_bp").parquet(path)
    spark = chunks.sparkSession
    windows = spark.read.parquet(path).withColumn(
        "standard_window_size_bp", F.col("standard_window_size_bp").cast("bigint")
    )
    pairs = W.pair_steps(sizes, steps)
    # Whole-sequence GC counts each base once; it uses the last non-overlapping size.
    last = windows.where(F.col("standard_window_size_bp") == pairs[-1][0])
    return {
        "windows": windows,
        "sequence_summary": W.sequence_summary(windows),
        "genome_summary": W.genome_summary(windows, chosen, genomes, pairs),
        "sequence_gc": W.sequence_gc(last),
    }


def export_window_tables(tables: dict[str, DataFrame], genomes: DataFrame, root: str, run_pk: int) -> dict[str, DataFrame]:
    """Chunked gzip tables with their manifests, as a database load expects them."""
    names = genomes.select("genome_pk", "accession_id")
    out = {}
    for table in ("sequence_summary", "genome_summary"):
        rows = tables[table].withColumn("run_pk", F.lit(run_pk).cast("bigint")).join(names, "genome_pk")
        columns = [c for c in rows.columns if c != "accession_id"]
        out[table] = write_chunks(rows, root, table, columns)
    return out
