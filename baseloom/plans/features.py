"""Orthologs, introns, flanks and their summaries from gene models and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from baseloom.operators import features as FT
from baseloom.operators import intervals as IV
from baseloom.operators.ranking import assign_pk
from baseloom.session import stored


def feature_tables(
    models: DataFrame, chunks: DataFrame, sequences: DataFrame, genomes: DataFrame, chunk_bp: int
) -> dict[str, DataFrame]:
    """Feature tables with keys.

    Coding sequences are cut once and stored; quality and composition start
    from them. Introns and flanks are taken for passing single-copy genes on
    known sequences.
    """
    key = ["genome_pk", "gene"]
    cds = stored(IV.extract_cds(models, chunks, chunk_bp))
    quality = FT.cds_quality(cds.select(*key, "seq"))
    joined = FT.assemble_orthologs(quality, cds, models)
    numbered = assign_pk(FT.attach_sequence_pk(joined, sequences), key, "ortholog_pk")
    orthologs = stored(numbered)
    usable = FT.valid_single(orthologs).where("sequence_pk IS NOT NULL").select(*key)
    chosen = models.join(usable, key, "left_semi")
    introns = stored(IV.intron_counts(IV.infer_introns(chosen), chunks, chunk_bp))
    flanks = stored(IV.extract_flanks(chosen, chunks, chunk_bp))
    return {
        "cds": cds,
        "quality": quality,
        "orthologs": orthologs,
        "introns": introns,
        "flanks": flanks,
        "ortholog_summary": FT.ortholog_summary(orthologs),
        "intron_summary": FT.intron_summary(introns, genomes),
        "flank_summary": FT.flank_summary(flanks, genomes),
    }
