"""Coding-sequence quality, composition, ortholog assembly and feature summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baseloom.functions import sequence as S
from baseloom.functions.kernels import cds_counts, mismatches
from baseloom.operators.stats import distribution, widen


def cds_composition(df: DataFrame, seq: str = "seq") -> DataFrame:
    """gc, gc3 and gc4 of coding sequences.

    gc3 is NULL when the length is no multiple of three or a stop lies inside;
    gc4 is NULL when the length without the last stop is no multiple of three,
    stops inside do not matter.
    """
    n = df.withColumn("_n", cds_counts(F.col(seq)))
    in_frame = F.col("_n.length") % 3 == 0
    acgt = F.col("_n.a") + F.col("_n.c") + F.col("_n.g") + F.col("_n.t")
    clean = in_frame & (F.col("_n.internal_stops") == 0)
    return (
        n.withColumn("gc", S.gc_fraction(F.col("_n.g") + F.col("_n.c"), acgt))
        .withColumn("gc3", F.when(clean, S.gc_fraction(F.col("_n.gc3"), F.col("_n.valid3"))))
        .withColumn("gc4", F.when(in_frame, S.gc_fraction(F.col("_n.gc4"), F.col("_n.valid4"))))
        .drop("_n")
    )


def cds_quality(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Quality columns of raw coding sequences with ordered failure reasons."""
    kept = [c for c in df.columns if c != seq]
    counts = df.withColumn("_n", cds_counts(F.col(seq)))
    acgt = F.col("_n.a") + F.col("_n.c") + F.col("_n.g") + F.col("_n.t")
    length = F.col("_n.length")
    counted = counts.select(
        *kept,
        length.alias("sequence_length"),
        (length % 3).alias("length_mod_3"),
        F.col("_n.internal_stops").alias("internal_stop_count"),
        (F.col("_n.last_stop") > 0).alias("terminal_stop"),
        F.floor((length - 3 * F.col("_n.last_stop")) / 3).cast("bigint").alias("protein_length"),
        *[F.col(f"_n.{b}").alias(f"{b}_count") for b in "atgcn"],
        F.col("_n.ambiguous").alias("ambiguous_count"),
        (length - F.col("_n.ambiguous") - acgt).alias("invalid_count"),
        acgt.alias("total_valid_bases"),
    )

    def fraction(name: str):
        return F.when(F.col("sequence_length") > 0, F.col(name) / F.col("sequence_length")).otherwise(0.0)

    checked = counted.withColumns(
        {
            "ambiguous_fraction": fraction("ambiguous_count"),
            "invalid_fraction": fraction("invalid_count"),
            "passes_length_mod_3": F.col("length_mod_3") == 0,
            "passes_internal_stop_check": F.col("internal_stop_count") == 0,
            "passes_invalid_base_check": F.col("invalid_count") == 0,
        }
    )
    # Failure reasons, in report order.
    reasons = {
        "passes_length_mod_3": "length_not_divisible_by_3",
        "passes_internal_stop_check": "internal_stop_codons",
        "passes_invalid_base_check": "invalid_characters",
    }
    listed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(c), F.lit(r)) for c, r in reasons.items()])), ";")
    passes = F.col("passes_length_mod_3") & F.col("passes_internal_stop_check") & F.col("passes_invalid_base_check")
    return checked.withColumn("passes_raw_cds_qc", passes).withColumn(
        "failure_reasons", F.when(passes, F.lit("pass")).otherwise(listed)
    )


def cds_quality_summary(quality: DataFrame) -> DataFrame:
    """Counts per accession and over all (accession NULL, ``is_total`` true)."""
    return (
        quality.rollup("accession")
        .agg(
            F.grouping("accession").cast("boolean").alias("is_total"),
            F.count(F.lit(1)).alias("total_sequences"),
            F.count_if("passes_raw_cds_qc").alias("passed_raw_cds_qc"),
            F.count_if(~F.col("passes_raw_cds_qc")).alias("failed_raw_cds_qc"),
            F.count_if(~F.col("passes_length_mod_3")).alias("failed_length_mod_3_check"),
            F.count_if(~F.col("passes_internal_stop_check")).alias("failed_internal_stop_check"),
            F.count_if(~F.col("passes_invalid_base_check")).alias("failed_invalid_base_check"),
            F.count_if("terminal_stop").alias("sequences_with_terminal_stop_codon"),
        )
    )


def assemble_orthologs(quality: DataFrame, cds: DataFrame, models: DataFrame) -> DataFrame:
    """Full join of quality flags, sequences and gene models per genome and gene.

    Composition is given only for sequences that pass.
    """
    key = ["genome_pk", "gene"]
    flags = quality.select(*key, F.col("passes_raw_cds_qc"))
    texts = cds.select(*key, "seq")
    gene = models.select(*key, "sequence_id", "status", "strand", "start", "end")
    joined = flags.join(texts, key, "full").join(gene, key, "full")
    joined = joined.withColumn("passes_raw_cds_qc", F.coalesce("passes_raw_cds_qc", F.lit(False)))
    usable = F.col("passes_raw_cds_qc") & (F.col("seq") != "")
    with_gc = cds_composition(joined.withColumn("_seq", F.when(usable, F.col("seq"))), "_seq")
    return with_gc.withColumn("length", F.length("_seq").cast("bigint")).drop("_seq", "seq")


def attach_sequence_pk(df: DataFrame, sequences: DataFrame) -> DataFrame:
    """Sequence key by genome and sequence name; NULL when unknown."""
    names = sequences.select("genome_pk", "sequence_id", "sequence_pk")
    return df.join(names, ["genome_pk", "sequence_id"], "left")


def valid_single(orthologs: DataFrame) -> DataFrame:
    """Orthologs that count in summaries: passed, with sequence, ``Single``."""
    return orthologs.where(F.col("passes_raw_cds_qc") & F.col("length").isNotNull() & (F.col("status") == "Single"))


_SPREAD = ["mean", "weighted_mean", "sd", "var", "median", "mad", "iqr"]


def _wanted(metrics: list[str], quantiles_of: str) -> dict[str, tuple[str, str]]:
    wanted = {f"{s}_{m}": (m, s) for m in metrics for s in _SPREAD}
    wanted.update({f"{q}_{quantiles_of}": (quantiles_of, q) for q in ("q05", "q25", "q75", "q95")})
    return wanted


def ortholog_summary(orthologs: DataFrame) -> DataFrame:
    """Statistics per genome over valid orthologs; one value has no spread."""
    used = valid_single(orthologs)
    totals = used.groupBy("genome_pk").agg(
        F.count(F.lit(1)).alias("n_orthologs"),
        F.sum("length").alias("callable_bp_total"),
        F.avg("length").alias("mean_ortholog_length"),
    )
    long = distribution(
        used,
        ["genome_pk"],
        {"gc": ("gc", "length"), "gc3": ("gc3", "length"), "gc4": ("gc4", "length"), "length": ("length", None)},
    )
    wanted = _wanted(["gc", "gc3", "gc4"], "gc3")
    wanted["median_ortholog_length"] = ("length", "median")
    return totals.join(widen(long, ["genome_pk"], wanted), "genome_pk", "left")


def _feature_summary(features, owners, keys, kind, extra) -> DataFrame:
    totals = features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"n_{kind}s"),
        F.countDistinct("gene").alias("n_orthologs"),
        F.sum("length").alias("callable_bp_total"),
        F.avg("length").alias(f"mean_{kind}_length"),
        *extra,
    )
    long = distribution(features, keys, {"gc": ("gc", "length"), "length": ("length", None)})
    wanted = _wanted(["gc"], "gc")
    wanted[f"median_{kind}_length"] = ("length", "median")
    counted = [f"n_{kind}s", "n_orthologs", "callable_bp_total"]
    found = F.col(f"n_{kind}s").isNotNull()
    return (
        owners.join(totals, keys, "left")
        .join(widen(long, keys, wanted), keys, "left")
        .withColumn(
            "recovery_status", F.when(found, "recovered").otherwise("not_recoverable_from_compleasm")
        )
        .fillna(0, counted)
    )


def intron_summary(introns: DataFrame, genomes: DataFrame) -> DataFrame:
    """Statistics per genome; genomes without introns get a zero row."""
    return _feature_summary(introns, genomes.select("genome_pk"), ["genome_pk"], "intron", [])


def flank_summary(flanks: DataFrame, genomes: DataFrame) -> DataFrame:
    """Statistics per genome and flank set; empty pairs get a zero row."""
    from baseloom.operators.intervals import FLANK_SETS

    owners = genomes.select(
        "genome_pk", F.explode(F.array(*[F.lit(k).cast("bigint") for k, *_ in FLANK_SETS])).alias("flank_set_pk")
    )
    extra = [
        F.avg("upstream_gc").alias("mean_upstream_gc"),
        F.avg("downstream_gc").alias("mean_downstream_gc"),
    ]
    return _feature_summary(flanks, owners, ["genome_pk", "flank_set_pk"], "flank", extra)


def compare_cds(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Compare two gene sets by key, else by header name.

    ``theirs`` has ``gene, header, seq``; ``ours`` has ``gene, seq``. Mismatches
    and identity are given for equal lengths.
    """
    by_key = ours.select(F.col("gene"), F.col("seq").alias("_by_key"))
    by_header = ours.select(F.col("gene").alias("header"), F.col("seq").alias("_by_header"))
    joined = theirs.join(by_key, "gene", "left").join(by_header, "header", "left")
    other = F.coalesce("_by_key", "_by_header")
    out = joined.withColumn("_o", other)
    same = F.length("seq") == F.length("_o")
    mism = mismatches(F.col("seq"), F.col("_o"))
    return out.select(
        "gene",
        "header",
        F.col("_o").isNotNull().alias("found"),
        (F.col("_o") == F.col("seq")).alias("exact_match"),
        F.length("seq").cast("bigint").alias("len_theirs"),
        F.length("_o").cast("bigint").alias("len_ours"),
        mism.alias("mismatches_same_len"),
        F.when(same, F.when(F.length("seq") > 0, 1 - mism / F.length("seq")).otherwise(0.0)).alias("identity_same_len"),
    )


def completeness(full: DataFrame) -> DataFrame:
    """Distinct genes per status with percentages of all genes; ``Complete`` is ``Single``."""
    status = F.when(F.col("status") == "Complete", "Single").otherwise(F.col("status"))
    # Statuses and their letters.
    letters = {"Single": "S", "Duplicated": "D", "Fragmented": "F", "Interspaced": "I", "Missing": "M"}
    genes = full.select("accession", "gene", status.alias("status")).distinct()
    counted = genes.groupBy("accession").agg(
        *[F.count_if(F.col("status") == s).alias(x.lower()) for s, x in letters.items()],
        F.countDistinct("gene").alias("n"),
    )
    for x in letters.values():
        counted = counted.withColumn(f"{x.lower()}_pct", F.col(x.lower()) * 100.0 / F.col("n"))
    return counted
