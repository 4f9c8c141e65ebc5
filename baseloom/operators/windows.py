"""Genomic windows: tiling, base counts, window sets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.functions.kernels import window_counter
from baseloom.functions.sequence import ADDITIVE_COUNTS, derived_count_columns
from baseloom.operators.stats import distribution, widen


def chunk_sequences(seqs: DataFrame, chunk_bp: int, bases: str = "bases") -> DataFrame:
    """Cut each sequence into rows of ``chunk_bp`` bases, numbered from 0."""
    pieces = F.regexp_extract_all(F.col(bases), F.lit(f"(?s).{{1,{chunk_bp}}}"), F.lit(0))
    kept = [c for c in seqs.columns if c != bases]
    return seqs.select(*kept, F.posexplode(pieces).alias("chunk_no", "bases")).withColumn(
        "chunk_no", F.col("chunk_no").cast("bigint")
    )


def pair_steps(sizes: list[int], steps: list[int] | None) -> list[tuple[int, int]]:
    """Window sizes with their steps; sizes repeat only once, lists must match."""
    steps = list(sizes) if steps is None else list(steps)
    if len(steps) != len(sizes):
        raise ValueError("as many steps as window sizes are needed")
    if min([*sizes, *steps]) <= 0:
        raise ValueError("window sizes and steps must be positive")
    return list(dict.fromkeys(zip(sizes, steps)))


def tile_windows(
    chunks: DataFrame,
    sizes: list[int],
    steps: list[int] | None = None,
    start_offset: int = 0,
    min_callable: float = 0.8,
    chunk_bp: int = 300_000,
    keys: tuple[str, ...] = ("genome_pk", "sequence_pk"),
) -> DataFrame:
    """Base counts of all windows of all sequences.

    Each chunk gives the counts of the windows it meets. Windows that lie whole
    on chunks (no overlap, size divides the chunk) are done with that, without
    a shuffle; the default sizes all divide the default chunk. The counts of
    others are added up over their chunks.
    """
    pairs = pair_steps(sizes, steps)
    offset = max(0, start_offset)
    inside = [s for s, step in pairs if s == step and offset == 0 and chunk_bp % s == 0]
    across = [(s, step) for s, step in pairs if not (s == step and s in inside)]
    parts = []
    if inside:
        parts.append(_chunk_windows(chunks, [(s, s) for s in inside], 0, chunk_bp, keys))
    if across:
        by = [*keys, "standard_window_size_bp", "step_size_bp", "window_rank0"]
        pieces = _chunk_windows(chunks, across, offset, chunk_bp, keys)
        parts.append(pieces.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ADDITIVE_COUNTS]))
    counted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    for name, column in derived_count_columns().items():
        counted = counted.withColumn(name, column)
    start = F.lit(offset) + F.col("window_rank0") * F.col("step_size_bp") + 1
    full = F.col("total_bp") == F.col("standard_window_size_bp")
    return (
        counted.withColumn("start_bp", start)
        .withColumn("end_bp", F.col("start_bp") + F.col("total_bp") - 1)
        .withColumn("mid_bp", F.floor((F.col("start_bp") + F.col("end_bp")) / 2).cast("bigint"))
        .withColumn("window_rank", F.col("window_rank0") + 1)
        .withColumn("keep_flag", full & (F.col("callable_frac") >= min_callable) & F.col("gc_prop").isNotNull())
        .withColumnRenamed("total_bp", "width_actual_bp")
        .drop("window_rank0")
    )


def _chunk_windows(chunks: DataFrame, pairs, offset: int, chunk_bp: int, keys) -> DataFrame:
    kinds = dict(chunks.dtypes)
    schema = [f"{k} {kinds[k]}" for k in keys]
    schema += [f"{c} bigint" for c in ["standard_window_size_bp", "step_size_bp", "window_rank0", *ADDITIVE_COUNTS]]
    run = window_counter(list(keys), pairs, offset, chunk_bp)
    return chunks.select(*keys, "chunk_no", "bases").mapInArrow(run, ", ".join(schema))


_SUMMARY = {
    "mean_gc": ("gc", "mean"),
    "weighted_mean_gc": ("gc", "weighted_mean"),
    "sd_gc": ("gc", "sd"),
    "var_gc": ("gc", "var"),
    "median_gc": ("gc", "median"),
    "mad_gc": ("gc", "mad"),
    "iqr_gc": ("gc", "iqr"),
    "q05_gc": ("gc", "q05"),
    "q25_gc": ("gc", "q25"),
    "q75_gc": ("gc", "q75"),
    "q95_gc": ("gc", "q95"),
    "mean_callable_fraction": ("callable", "mean"),
    "median_callable_fraction": ("callable", "median"),
}


def window_summary(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Window counts and GC statistics over kept windows, per key, size and step.

    One value has spread 0; without kept windows the statistics are NULL and
    the base totals 0.
    """
    by = [*keys, "standard_window_size_bp", "step_size_bp"]
    short = F.col("width_actual_bp") < F.col("standard_window_size_bp")

    def kept_sum(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("keep_flag"), F.col(name))), F.lit(0))

    totals = windows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_windows_total"),
        F.count_if("keep_flag").alias("n_windows_kept"),
        F.count_if(~F.col("keep_flag") & ~short).alias("n_windows_excluded_missing"),
        F.count_if(~F.col("keep_flag") & short).alias("n_windows_excluded_short"),
        kept_sum("callable_bp").alias("callable_bp_total"),
        kept_sum("gap_bp").alias("gap_bp_total"),
    )
    kept = windows.where("keep_flag")
    long = distribution(
        kept, by, {"gc": ("gc_prop", "callable_bp"), "callable": ("callable_frac", None)}, single_spread=0.0
    )
    return totals.join(widen(long, by, _SUMMARY), by, "left")


def sequence_summary(windows: DataFrame) -> DataFrame:
    return window_summary(windows, ["genome_pk", "sequence_pk"])


def genome_summary(
    windows: DataFrame, sequences: DataFrame, genomes: DataFrame, pairs: list[tuple[int, int]]
) -> DataFrame:
    """Per genome and window size, pooled over sequences; also for genomes without windows."""
    by = ["genome_pk", "standard_window_size_bp", "step_size_bp"]
    used = sequences.groupBy("genome_pk").agg(
        F.count(F.lit(1)).alias("seq_count_used"),
        F.when(F.sum("sequence_length") > 0, F.max("sequence_length") / F.sum("sequence_length")).alias(
            "largest_seq_fraction"
        ),
    )
    grid = genomes.select(
        "genome_pk",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s).cast("bigint").alias("standard_window_size_bp"),
                        F.lit(t).cast("bigint").alias("step_size_bp"),
                    )
                    for s, t in pairs
                ]
            )
        ),
    )
    summary = window_summary(windows, ["genome_pk"]).drop(
        "n_windows_excluded_missing", "n_windows_excluded_short", "median_callable_fraction"
    )
    counted = ["n_windows_total", "n_windows_kept", "callable_bp_total", "gap_bp_total", "seq_count_used"]
    return grid.join(summary, by, "left").join(used, "genome_pk", "left").fillna(0, counted)


def sequence_gc(windows: DataFrame) -> DataFrame:
    """Whole-sequence GC over all windows, short and masked ones too."""
    totals = windows.groupBy("sequence_pk").agg(
        F.sum("gc_bp").alias("gc_bp"), F.sum("callable_bp").alias("callable_bp")
    )
    return totals.withColumn("gc", F.when(F.col("callable_bp") > 0, F.col("gc_bp") / F.col("callable_bp")))


# Scope labels of common sequence-type choices.
SCOPES = {
    ("chromosome",): "chromosome_only",
    ("scaffold",): "scaffold_only",
    ("chromosome", "scaffold"): "chromosome_plus_scaffold",
    ("chromosome", "mitochondrion", "scaffold"): "all_sequences",
}


def scope_label(types: list[str]) -> str:
    chosen = tuple(sorted({t.strip().lower() for t in types if t.strip()}))
    return SCOPES.get(chosen, "_plus_".join(chosen))


def filter_sequence_types(df: DataFrame, types: list[str]) -> DataFrame:
    chosen = sorted({t.strip().lower() for t in types if t.strip()})
    kept = df.where(F.lower("sequence_type").isin(chosen)) if chosen else df
    return kept.withColumn("seq_scope", F.lit(scope_label(types)))


def window_sets(
    genomes: DataFrame,
    sizes: list[int],
    steps: list[int] | None,
    run_pk: int,
    types: list[str],
    start_offset: int = 0,
    tiling_type: str = "fixed",
) -> DataFrame:
    """One row per genome and window size, numbered by genome and given order."""
    from baseloom.operators.ranking import assign_pk

    pairs = pair_steps(sizes, steps)
    grid = genomes.select(
        "genome_pk",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_place"),
                        F.lit(s).cast("bigint").alias("standard_window_size_bp"),
                        F.lit(t).cast("bigint").alias("step_size_bp"),
                    )
                    for i, (s, t) in enumerate(pairs)
                ]
            )
        ),
    )
    numbered = assign_pk(grid, ["genome_pk", "_place"], "window_set_pk")
    return numbered.select(
        "window_set_pk",
        F.lit(run_pk).cast("bigint").alias("run_pk"),
        "genome_pk",
        F.lit(tiling_type).alias("tiling_type"),
        "standard_window_size_bp",
        "step_size_bp",
        F.lit(start_offset).cast("bigint").alias("start_offset_bp"),
        F.lit(scope_label(types)).alias("seq_scope"),
    )


def analysis_run(spark, run_pk: int, name: str, created_at: str, **settings) -> DataFrame:
    """The one-row description of a run; the time is given, so runs repeat."""
    row = spark.range(1).select(
        F.lit(run_pk).cast("bigint").alias("run_pk"),
        F.lit(name).alias("analysis_name"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )
    for key, value in settings.items():
        row = row.withColumn(key, F.lit(value))
    return row


def sequence_type_audit(sequences: DataFrame, genomes: DataFrame, stats: DataFrame) -> DataFrame:
    """Inferred sequence counts per genome against the reported statistics."""
    kind = F.col("sequence_type")
    known = ["chromosome", "scaffold", "mitochondrion"]
    counts = sequences.groupBy("genome_pk").agg(
        F.count(F.lit(1)).alias("n_fasta_sequences"),
        *[F.count_if(kind == k).alias(f"n_{k}_inferred") for k in known],
        F.count_if(~F.coalesce(kind, F.lit("unclassified")).isin(known)).alias("n_unclassified_inferred"),
    )
    counted = [c for c in counts.columns if c != "genome_pk"]
    chromosomes = F.col("n_chromosome_inferred") == F.col("ncbi_total_chromosomes")
    components = F.col("n_fasta_sequences") == F.col("ncbi_component_sequences")
    return (
        genomes.select("genome_pk", "accession_id")
        .join(counts, "genome_pk", "left")
        .fillna(0, counted)
        .join(stats, "accession_id", "left")
        .withColumn("chromosome_count_match", chromosomes)
        .withColumn("component_sequence_count_match", components)
        .withColumn(
            "audit_status",
            F.when(chromosomes & components, "pass")
            .when(chromosomes.isNull() | components.isNull(), "missing_ncbi_stats")
            .otherwise("review"),
        )
    )


# Header patterns by sequence type, tried in the order of `classify_sequence`.
MITOCHONDRIAL = [
    r"\bmitochondrion\b",
    r"\bmitochondrial\b",
    r"\bmitogenome\b",
    r"\bmt\s+genome\b",
    r"\bmtdna\b",
    r"\bchrm\b",
    r"\bchr\s*m\b",
    r"\bchromosome\s+m\b",
]
EXPLICIT_SCAFFOLD = [r"\bunplaced\b", r"\bunlocalized\b", r"\bscaffold\b", r"\bscaf\b", r"\bcontig\b", r"\bctg\b"]
CHROMOSOMAL = [
    r"\bchromosome\b",
    r"\bchrom\s+[0-9ivxlcdmxyzw]+\b",
    r"\bchr\s*[0-9ivxlcdmxyzw]+\b",
    r"\bmicrochromosome\b",
    r"\bmacrochromosome\b",
    r"\blinkage\s+group\b",
    r"\blg\s*[0-9a-z]+\b",
]
SHOTGUN = [r"\bwgs\s+sequence\b", r"\bshotgun\s+sequence\b", r"\bgenomic\s+scaffold\b", r"\bgenomic\s+contig\b"]
CHROMOSOME_PREFIX = r"^(NC|CM|OX|OW|CP)_"
SCAFFOLD_PREFIX = r"^(NW|NT|NZ)_"
WGS_ACCESSION = r"^[A-Z]{4,6}\d{6,}\.\d+$"


def classify_sequence(sequence_id: Column, description: Column) -> Column:
    """Sequence type from the identifier and the header text."""
    text = F.lower(F.concat_ws(" ", sequence_id, F.coalesce(description, F.lit(""))))
    text = F.regexp_replace(F.regexp_replace(text, r"[|_\-:;,\[\]()=]+", " "), r"\s+", " ")
    name = F.upper(sequence_id)

    def says(patterns: list[str]) -> Column:
        return text.rlike("|".join(patterns))

    return (
        F.when(says(MITOCHONDRIAL), "mitochondrion")
        .when(name.rlike(CHROMOSOME_PREFIX), "chromosome")
        .when(name.rlike(SCAFFOLD_PREFIX), "scaffold")
        .when(says(EXPLICIT_SCAFFOLD), "scaffold")
        .when(says(CHROMOSOMAL), "chromosome")
        .when(says(SHOTGUN), "scaffold")
        .when(name.rlike(WGS_ACCESSION), "scaffold")
        .otherwise("unclassified")
    )
