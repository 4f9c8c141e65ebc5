"""NULL, boolean, number, path and file-name clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words read as NULL, by reader. Builder and feature reader ignore case.
BUILDER_NULLS = ["", "nan", "none", "null", "na"]
LOADER_NULLS = ["", "\\N", "NULL", "null", "None", "none", "NaN", "nan", "NA", "na"]
FEATURE_NULLS = ["", "na", "nan", "none", "null", "<na>"]

# Words read as true and false, by reader.
BUILDER_TRUE = ["true", "t", "1", "yes", "y"]
BUILDER_FALSE = ["false", "f", "0", "no", "n"]
FEATURE_TRUE = ["true", "t", "1", "yes", "y", "pass", "passed"]
LOADER_TRUE = ["true", "t", "1", "yes", "y", "pass", "passed"]
LOADER_FALSE = ["false", "f", "0", "no", "n", "fail", "failed"]
FLAG_TRUE = ["true", "1", "yes", "y"]

# Columns searched for a genome FASTA path, best first.
FASTA_PATH_COLUMNS = [
    "path_to_fna",
    "pathway_to_genome",
    "path_to_genome",
    "genome_fna_path",
    "genome_fasta_path",
    "genomic_fna_path",
    "genomic_fasta_path",
    "genome_path",
    "genomic_fna",
    "genomic_fasta",
    "fna_path",
    "fasta_path",
    "path",
]
# File-name words of FASTA files that hold no genome.
NON_GENOMIC_WORDS = [
    "proteome",
    "protein",
    "proteins",
    "pep",
    "peptide",
    "peptides",
    "cds",
    "rna",
    "mrna",
    "transcript",
    "transcripts",
    "transcriptome",
]


def null_if_blank(col: Column, mode: str = "builder") -> Column:
    text = F.trim(col.cast("string"))
    if mode == "builder":
        missing = F.lower(text).isin(BUILDER_NULLS)
    elif mode == "loader":
        missing = text.isin(LOADER_NULLS)
    elif mode == "feature":
        missing = F.lower(text).isin(FEATURE_NULLS)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.when(~missing, text)


def canonical_null(df: DataFrame, mode: str = "builder", columns: list[str] | None = None) -> DataFrame:
    """NULL words of the string columns become NULL; other text is trimmed."""
    chosen = columns or [n for n, t in df.dtypes if t == "string"]
    return df.select(*[null_if_blank(F.col(n), mode).alias(n) if n in chosen else F.col(n) for n in df.columns])


def canonical_bool(col: Column, mode: str = "builder") -> Column:
    """``builder`` unknown words give NULL, ``feature`` and ``flag`` false, ``strict`` an error."""
    word = F.lower(F.trim(col.cast("string")))
    if mode == "builder":
        return F.when(word.isin(BUILDER_TRUE), True).when(word.isin(BUILDER_FALSE), False)
    if mode == "feature":
        return F.coalesce(word.isin(FEATURE_TRUE), F.lit(False))
    if mode == "flag":
        return F.coalesce(word.isin(FLAG_TRUE), F.lit(False))
    if mode == "strict":
        return (
            F.when(word.isNull() | word.isin(FEATURE_NULLS), F.lit(None).cast("boolean"))
            .when(word.isin(LOADER_TRUE), True)
            .when(word.isin(LOADER_FALSE), False)
            .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), word)).cast("boolean"))
        )
    raise ValueError(f"unknown mode {mode!r}")


# Decimal numbers that a double can hold.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE](\+?(\d{1,2}|[12]\d\d|30[0-7])|-\d+))?$"


def to_number(col: Column) -> Column:
    """Lenient double; what is no finite number is NULL.

    The pattern comes first: a cast that fails costs an exception per row.
    """
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_integer(col: Column) -> Column:
    """Lenient integer through double, cut towards zero."""
    return to_number(null_if_blank(col)).cast("bigint")


def file_token(col: Column) -> Column:
    """Text that is safe in a file name."""
    text = F.regexp_replace(F.trim(col.cast("string")), "[^A-Za-z0-9._-]+", "_")
    text = F.trim(F.regexp_replace(text, "_+", "_"), F.lit("_"))
    return F.when(text == "", F.lit("unknown")).otherwise(text)


def repath(col: Column, root: str) -> Column:
    """Put the part after the root folder's name below ``root``."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    text = F.trim(col)
    tail = F.regexp_replace(F.split(text, _quoted(name), 2).getItem(1), r"^[/\\]+", "")
    return (
        F.when(text.isNull() | (text == "") | (F.lower(text) == "nan"), F.lit(""))
        .when(text.contains(name), F.concat(F.lit(root.rstrip("/") + "/"), tail))
        .otherwise(text)
    )


def repath_records(col: Column, root: str) -> Column:
    """Put the part from the ``records`` folder on below ``root``."""
    tail = F.regexp_extract(col, r"(?:^|/)(records/.*)$", 1)
    return F.when(tail != "", F.concat(F.lit(root.rstrip("/") + "/"), tail)).otherwise(col)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def is_genomic_fasta(path: Column) -> Column:
    """A FASTA suffix, no old or archive folder, no CDS or protein word in the name."""
    low = F.lower(path)
    parts = F.split(low, "/")
    words = F.split(F.element_at(parts, -1), "[^a-z0-9]+")
    return (
        low.rlike(r"\.(fna|fa|fasta)(\.gz)?$")
        & ~F.arrays_overlap(parts, F.array(*[F.lit(w) for w in ("old", "archive", "archived")]))
        & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in NON_GENOMIC_WORDS]))
    )


def is_critical_limit(col: Column, kind: str) -> Column:
    """The metric label names a critical thermal ``max`` or ``min``."""
    word = F.regexp_replace(F.lower(F.trim(col)), "[-_ ]", "")
    # Spellings of the critical limits.
    names = {
        "max": ["ctmax", "criticalthermalmaximum", "criticalthermalmax"],
        "min": ["ctmin", "criticalthermalminimum", "criticalthermalmin"],
    }[kind]
    return F.coalesce(word.isin(names), F.lit(False))
