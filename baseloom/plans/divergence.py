"""Divergence tables from annotated trees, likelihoods and a node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baseloom.operators import divergence as D
from baseloom.operators.ranking import dedupe_last
from baseloom.session import stored
from baseloom.sources import trees_text as TT


def divergence_tables(
    trees: DataFrame,
    likelihoods: DataFrame,
    edges: DataFrame,
    n_species: int,
    gc4: DataFrame,
    metadata: DataFrame,
    strict: bool = False,
    suffixes: tuple[str, str] = (".tree", ".lk"),
) -> dict[str, DataFrame]:
    """GC per node, edge and ancestor distances, and the master species table.

    ``trees`` and ``likelihoods`` have ``name, text``, one row per file.
    """
    pairs = stored(TT.pair_ortholog_files(trees, likelihoods, *suffixes, strict=strict))
    parsed = TT.parse_gc_trees(pairs.select("ortholog", F.col("tree_text").alias("text")), n_species)
    root = TT.parse_ancestral_gc(pairs.select("ortholog", F.col("lk_text").alias("text")))
    per_gene = stored(
        parsed.unionByName(root.select("ortholog", F.lit(-1).cast("bigint").alias("pos"), F.lit("ancestral").alias("node"), "gc"))
    )
    # A label that occurs twice in a tree counts with its last value.
    node_gc = stored(dedupe_last(per_gene, ["ortholog", "node"], ["pos"]).select("ortholog", "node", "gc"))
    if strict:
        D.require_complete(node_gc, edges)
    summary = D.gc3_summary(per_gene)
    ancestor = D.dianc(node_gc)
    return {
        "gc3_per_gene": per_gene,
        "gc3_summary": summary,
        "dij": D.dij(node_gc, edges),
        "dianc": ancestor,
        "master": D.master_table(summary, ancestor, gc4, metadata),
    }
