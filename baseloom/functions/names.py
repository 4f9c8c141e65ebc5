"""Species-name and label keys, as named modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Taxonomic qualifiers and hybrid marks that are not name parts.
QUALIFIERS = ["sp", "spp", "cf", "aff", "nr"]
HYBRID_MARKS = ["x", "×"]
# Words that stand for a missing species name.
NULL_NAMES = ["nan", "none", "na", "n/a"]
UNKNOWN = "unknown_species"


def _tokens(text: Column) -> Column:
    """Words of a name: split on underscores if there are any, else on spaces."""
    by_underscore = F.split(text, "_")
    by_space = F.split(text, r"\s+")
    return F.filter(F.when(text.contains("_"), by_underscore).otherwise(by_space), lambda t: t != "")


def _first_two(tokens: Column, empty: str | None) -> Column:
    # The tokens are named once, so that they are built once per row.
    return F.coalesce(F.nullif(F.array_join(F.slice(tokens, 1, 2), "_"), F.lit("")), F.lit(empty))


def _full(text: Column) -> Column:
    text = F.regexp_replace(text, r"\([^)]*\)", " ")
    text = F.regexp_replace(F.translate(text, "-.", "  "), r"[^A-Za-z0-9_\s]", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", "_"), "_+", "_")
    return F.lower(F.trim(text, F.lit("_")))


def _taxon(text: Column, drop_brackets: bool) -> Column:
    text = F.regexp_replace(F.translate(text, "_", " "), r"\([^)]*\)", " ")
    if drop_brackets:
        text = F.regexp_replace(text, r"\[[^\]]*\]", " ")
    text = F.regexp_replace(text, r"[^A-Za-z×\s.\-]", " ")
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda t: F.lower(F.trim(t, F.lit("."))))
    return F.filter(words, lambda t: (t != "") & ~t.isin(QUALIFIERS + HYBRID_MARKS))


def _label(text: Column) -> Column:
    text = F.regexp_replace(text, "['\"]", "")
    text = F.regexp_replace(text, r"\[.*?\]|\(.*?\)", "")
    return F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def normalize_species(col: Column, mode: str = "taxon") -> Column:
    """Species key of a raw name.

    ``ncbi``            spaces to ``_``, case kept
    ``binomial``        first two words, case kept
    ``binomial_lower``  the same in lower case
    ``full``            symbols dropped, all words kept, lower case
    ``full_key``        first two words of ``full``
    ``taxon``           letters only, qualifiers dropped, first two words
    ``trait``           as ``taxon``, also without ``[...]`` and null words
    ``label``           quotes and bracketed parts dropped, rest to ``_``
    ``label_key``       first two words of ``label``
    ``display``         ``Genus_species``
    ``shell``           first two words, only ``[a-z0-9_]`` kept
    """
    text = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    if mode == "ncbi":
        return F.regexp_replace(text, r"\s+", "_")
    if mode == "binomial":
        return _first_two(_tokens(text), UNKNOWN)
    if mode == "binomial_lower":
        return F.lower(_first_two(_tokens(text), UNKNOWN))
    if mode == "full":
        return _full(text)
    if mode == "full_key":
        return F.array_join(F.slice(F.split(_full(text), "_"), 1, 2), "_")
    if mode == "taxon":
        return _first_two(_taxon(text, False), UNKNOWN)
    if mode == "trait":
        return F.when(F.lower(text).isin(NULL_NAMES), F.lit(UNKNOWN)).otherwise(
            _first_two(_taxon(text, True), UNKNOWN)
        )
    if mode == "label":
        return _label(text)
    if mode == "label_key":
        return F.array_join(
            F.slice(F.filter(F.split(_label(text), "_"), lambda t: t != ""), 1, 2), "_"
        )
    if mode == "display":
        key = F.lower(_first_two(_tokens(text), UNKNOWN))
        return F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 1 << 20))
    if mode == "shell":
        words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
        two = F.concat_ws("_", F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.coalesce(F.get(words, F.lit(1)), F.lit("")))
        joined = F.when(text.contains("_"), text).otherwise(two)
        return F.regexp_replace(F.regexp_replace(F.lower(joined), "[^a-z0-9_]", ""), "_$", "")
    raise ValueError(f"unknown mode {mode!r}")


def genus_of(key: Column) -> Column:
    return F.substring_index(key, "_", 1)


def coerce_node(col: Column) -> Column:
    """Tree-node label: ``ancestral``, ``node_<n>`` or a species key."""
    text = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    low = F.lower(text)
    number = F.regexp_extract(low, r"^(?:node[\s_\-]*)?(\d+)$", 1)
    return (
        F.when(text == "", F.lit(""))
        .when(low.isin("ancestor", "ancestral", "root"), F.lit("ancestral"))
        .when(number != "", F.concat(F.lit("node_"), number.try_cast("bigint").cast("string")))
        .when(low.startswith("node_"), low)
        .otherwise(normalize_species(text, "binomial_lower"))
    )


def is_internal(node: Column) -> Column:
    return node.startswith("node_")


def is_tip(node: Column) -> Column:
    return ~is_internal(node) & (node != "ancestral")


def extract_accession(label: Column) -> Column:
    """Versioned assembly accession inside a label, else NULL."""
    return F.nullif(F.regexp_extract(label, r"GC[AF]_[0-9]+\.[0-9]+", 0), F.lit(""))


def accession_root(col: Column) -> Column:
    return F.substring_index(F.trim(col), ".", 1)


def accession_version(col: Column) -> Column:
    """Digits after the last point, else -1."""
    return F.coalesce(F.regexp_extract(F.trim(col), r"\.(\d+)$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))
