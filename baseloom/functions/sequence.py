"""Column expressions on nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from baseloom.functions.kernels import STANDARD_CODE, base_counts, reverse_complement, translate  # noqa: F401

def count_char(seq: Column, char: str) -> Column:
    """Occurrences of one character."""
    return (F.length(seq) - F.length(F.replace(seq, F.lit(char), F.lit("")))).cast("long")


def orient(seq: Column, strand: Column) -> Column:
    """The sequence as read on its strand; only ``-`` is turned round."""
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def codons(seq: Column) -> Column:
    """Complete codons as an array, in one pass over the text."""
    return F.regexp_extract_all(seq, F.lit("(?s)..."), F.lit(0))


def gc_fraction(gc: Column, callable_bp: Column) -> Column:
    """GC over callable bases, NULL when there is none."""
    return F.when(callable_bp > 0, gc / callable_bp)


def translate_dna(seq: Column) -> Column:
    """Amino acids by the standard code; unknown codons give X."""
    return translate(seq)


def with_base_counts(df, seq: Column):
    """Add the additive counts of one sequence column."""
    return df.withColumn("_n", base_counts(seq)).select(*df.columns, "_n.*")


# The additive part of a base count, in column order.
ADDITIVE_COUNTS = ["a_count", "c_count", "g_count", "t_count", "n_count", "gap_bp", "total_bp"]


def derived_count_columns() -> dict[str, Column]:
    """What follows from the additive counts."""
    acgt = F.col("a_count") + F.col("c_count") + F.col("g_count") + F.col("t_count")
    gc = F.col("g_count") + F.col("c_count")
    return {
        "other_count": F.col("total_bp") - acgt - F.col("n_count") - F.col("gap_bp"),
        "callable_bp": acgt,
        "gc_bp": gc,
        "gc_prop": gc_fraction(gc, acgt),
        "callable_frac": F.when(F.col("total_bp") > 0, acgt / F.col("total_bp")),
        "masked_bp": F.col("n_count"),
    }
