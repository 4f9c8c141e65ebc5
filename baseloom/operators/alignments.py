"""Codon alignments: masks, four-fold GC, frameshifts, cleaning, supermatrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baseloom.functions.kernels import THIRD_FIELDS, codon_words, kept_thirds
from baseloom.functions.sequence import count_char
from baseloom.operators.ranking import dense_rank_desc, exact_quantiles, running_total

# Characters that make an alignment site incomplete.
INVALID = "-!N"


def validate_alignments(aln: DataFrame) -> DataFrame:
    """Alignments with unequal lengths or a length that is no multiple of three."""
    lengths = aln.groupBy("alignment").agg(
        F.min(F.length("seq")).cast("bigint").alias("min_length"),
        F.max(F.length("seq")).cast("bigint").alias("max_length"),
        F.count_if(F.length("seq") % 3 != 0).alias("n_out_of_frame"),
    )
    unequal = F.when(F.col("min_length") != F.col("max_length"), F.lit("unequal_lengths"))
    frame = F.when(F.col("n_out_of_frame") > 0, F.lit("length_not_divisible_by_3"))
    listed = lengths.withColumn("problem", F.array_join(F.array_compact(F.array(unequal, frame)), ";"))
    return listed.where(F.col("problem") != "")


def require_valid_alignments(aln: DataFrame, shown: int = 20) -> DataFrame:
    """Stop with the first messages if any alignment is bad."""
    bad = validate_alignments(aln).orderBy("alignment").limit(shown).collect()
    if bad:
        raise ValueError("; ".join(f"{r['alignment']}: {r['problem']}" for r in bad))
    return aln


def _codon_masks(aln: DataFrame, invalid: str, same_family: bool) -> DataFrame:
    """Per alignment: site and codon counts and the bits of the retained codons.

    Each sequence gives one row per 64 codons; these are combined by bit
    operations before the shuffle. The result is no wider than a sequence.
    """
    sites, family = ["s1", "s2", "s3", "fourfold"], ["f0", "f1", "f2"]
    # Counts of a whole sequence ride on its first word.
    whole = {
        "n_sequences_in_alignment": F.lit(1),
        "invalid_char_gap": count_char(F.col("seq"), "-"),
        "invalid_char_frameshift": count_char(F.col("seq"), "!"),
        "invalid_char_N": count_char(F.col("seq"), "N"),
    }
    counted = aln.select(
        "alignment",
        F.length("seq").cast("bigint").alias("alignment_length_nt"),
        *[c.alias(n) for n, c in whole.items()],
        F.inline(codon_words(invalid)(F.col("seq"))),
    )
    words = counted.groupBy("alignment", "word").agg(
        F.max("n_codons").alias("n_codons"),
        F.max("alignment_length_nt").alias("alignment_length_nt"),
        *[F.sum(F.when(F.col("word") == 0, F.col(n))).alias(n) for n in whole],
        *[F.bit_and(c).alias(c) for c in sites],
        *[F.bit_and(c).alias(f"{c}_all") for c in family],
        *[F.bit_or(c).alias(f"{c}_any") for c in family],
    )
    differs = " | ".join(f"({c}_all ^ {c}_any)" for c in family)
    marked = words.withColumn("_complete", F.expr("s1 & s2 & s3")).withColumn("_candidate", F.expr("_complete & fourfold"))
    marked = marked.withColumn("_mixed", F.expr(f"_candidate & ({differs})") if same_family else F.lit(0).cast("bigint"))
    marked = marked.withColumn("_kept", F.expr("_candidate & ~_mixed"))

    def bits(column: str) -> Column:
        return F.sum(F.bit_count(column)).cast("bigint")

    words_in_order = F.array_sort(F.collect_list(F.struct("word", "_kept")))
    return marked.groupBy("alignment").agg(
        F.sum("n_codons").alias("total_codons"),
        (bits("s1") + bits("s2") + bits("s3")).alias("complete_sites_nt"),
        bits("_complete").alias("complete_codons"),
        bits("_candidate").alias("candidate_gc4_codons_all_sequences"),
        bits("_mixed").alias("dropped_mixed_gc4_family"),
        bits("_kept").alias("retained_gc4_codons"),
        F.max("alignment_length_nt").alias("alignment_length_nt"),
        *[F.sum(n).cast("bigint").alias(n) for n in whole],
        F.transform(words_in_order, lambda w: w["_kept"]).alias("_kept"),
    )


def gc4_alignment(aln: DataFrame, invalid: str = INVALID, same_family: bool = False) -> DataFrame:
    """GC at four-fold sites that are complete in all sequences of an alignment.

    A codon counts when all its sites are valid in every sequence and every
    sequence has a four-fold prefix there; with ``same_family`` also the same
    prefix. GC is 0 where no valid base is left.
    """
    up = aln.withColumn("seq", F.upper("seq"))
    masks = _codon_masks(up, invalid.upper(), same_family)
    joined = up.join(masks, "alignment")
    out = joined.withColumn("_third", kept_thirds(F.col("seq"), F.col("_kept"))).select("*", "_third.*")
    valid = F.col("g_gc4") + F.col("c_gc4") + F.col("a_gc4") + F.col("t_gc4")
    return out.select(
        "alignment",
        "sequence_id",
        F.when(valid > 0, (F.col("g_gc4") + F.col("c_gc4")) / valid).otherwise(0.0).alias("gc4"),
        *THIRD_FIELDS,
        valid.alias("valid_gc4_bases"),
        F.col("retained_gc4_codons").alias("retained_gc4_sites"),
        "retained_gc4_codons",
        "n_sequences_in_alignment",
        "alignment_length_nt",
        F.col("alignment_length_nt").alias("total_sites_nt"),
        "complete_sites_nt",
        (F.col("alignment_length_nt") - F.col("complete_sites_nt")).alias("dropped_sites_incomplete_nt"),
        "total_codons",
        "complete_codons",
        (F.col("total_codons") - F.col("complete_codons")).alias("dropped_incomplete_codons"),
        "candidate_gc4_codons_all_sequences",
        (F.col("complete_codons") - F.col("candidate_gc4_codons_all_sequences")).alias(
            "dropped_not_gc4_all_sequences"
        ),
        "dropped_mixed_gc4_family",
        F.lit("ok").alias("status"),
        "invalid_char_gap",
        "invalid_char_frameshift",
        "invalid_char_N",
    )


# Detail columns that are added up per species.
SUMMED = [
    "g_gc4",
    "c_gc4",
    "a_gc4",
    "t_gc4",
    "n_gc4",
    "valid_gc4_bases",
    "retained_gc4_sites",
    "retained_gc4_codons",
    "alignment_length_nt",
    "total_sites_nt",
    "complete_sites_nt",
    "dropped_sites_incomplete_nt",
    "total_codons",
    "complete_codons",
    "dropped_incomplete_codons",
    "candidate_gc4_codons_all_sequences",
    "dropped_not_gc4_all_sequences",
    "dropped_mixed_gc4_family",
    "invalid_char_gap",
    "invalid_char_frameshift",
    "invalid_char_N",
]


def gc4_species(detail: DataFrame) -> DataFrame:
    """Four-fold GC per sequence as ratio of sums over alignments."""
    summed = detail.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n_alignments"),
        F.count_if(F.col("valid_gc4_bases") > 0).alias("alignments_with_retained_gc4"),
        *[F.sum(c).alias(c) for c in SUMMED],
    )
    valid = F.col("valid_gc4_bases")
    return summed.withColumn("gc4", F.when(valid > 0, (F.col("g_gc4") + F.col("c_gc4")) / valid).otherwise(0.0))


def gc4_mean(detail: DataFrame, key: str = "genus_species") -> DataFrame:
    """Mean, spread and number of four-fold GC values per species."""
    return (
        detail.where(F.col(key).isNotNull() & F.col("gc4").isNotNull())
        .groupBy(key)
        .agg(
            F.avg("gc4").alias("mean_gc4"),
            F.stddev_samp("gc4").alias("sd_gc4"),
            F.count("gc4").alias("n_gc4_values"),
        )
    )


def frameshifts(aln: DataFrame, errors: int) -> DataFrame:
    """Frameshift marks per gene and accession; more than ``errors`` filters the sequence."""
    marks = count_char(F.col("seq"), "!")
    return aln.select(
        F.col("alignment").alias("gene_id"),
        F.col("sequence_id").alias("accession"),
        marks.alias("frameshifts"),
        (marks > errors).alias("sequence_filtered"),
    )


def clean_alignments(aln: DataFrame, errors: int, total_species: Column | int, threshold: float) -> DataFrame:
    """Sequences of genes that keep enough species; marks become gaps."""
    total = total_species if isinstance(total_species, Column) else F.lit(total_species)
    clean = aln.where(count_char(F.col("seq"), "!") <= errors)
    kept = gene_occupancy(aln, errors).where(F.col("n_clean") / total >= threshold)
    return clean.join(kept.select("alignment"), "alignment", "left_semi").withColumn(
        "seq", F.translate("seq", "!", "-")
    )


def gene_occupancy(aln: DataFrame, errors: int) -> DataFrame:
    """Clean and all sequences per gene."""
    return aln.groupBy("alignment").agg(
        F.count_if(count_char(F.col("seq"), "!") <= errors).alias("n_clean"), F.count(F.lit(1)).alias("n_all")
    )


def cleaning_summary(aln: DataFrame, errors: int, total_species: Column | int, threshold: float) -> DataFrame:
    """One row: genes seen, dropped, retained. The dropped ids are `dropped_genes`."""
    total = total_species if isinstance(total_species, Column) else F.lit(total_species)
    enough = F.col("n_clean") / total >= threshold
    return gene_occupancy(aln, errors).agg(
        F.lit(float(threshold)).alias("threshold"),
        F.lit(errors).cast("bigint").alias("errors"),
        F.count(F.lit(1)).alias("total_genes_analyzed"),
        F.count_if(~enough).alias("genes_dropped"),
        F.count_if(enough).alias("genes_retained"),
    )


def dropped_genes(aln: DataFrame, errors: int, total_species: Column | int, threshold: float) -> DataFrame:
    total = total_species if isinstance(total_species, Column) else F.lit(total_species)
    return gene_occupancy(aln, errors).where(F.col("n_clean") / total < threshold).select("alignment")


def score_problems(
    fs: DataFrame, unit: str, rejected_only: bool = True, aggressive: bool = False
) -> DataFrame:
    """Problem scores per ``gene_id`` or per ``accession``.

    The fraction is over all distinct partners before filtering; the ranks are
    among the rows that remain.
    """
    partner = "accession" if unit == "gene_id" else "gene_id"
    rows = fs.where("sequence_filtered") if rejected_only else fs
    total = fs.agg(F.greatest(F.countDistinct(partner), F.lit(1))).scalar()
    scored = rows.groupBy(unit).agg(
        F.count(F.lit(1)).alias("problem_count"),
        F.sum("frameshifts").alias("total_frameshifts"),
        F.avg("frameshifts").alias("mean_frameshifts"),
        F.countDistinct(partner).alias("_partners"),
    )
    scored = scored.withColumn("problem_fraction", F.col("problem_count") / total)
    scored = dense_rank_desc(scored, "problem_count", "count_rank")
    scored = dense_rank_desc(scored, "total_frameshifts", "frameshift_rank")
    weight = F.col("total_frameshifts") + F.col("mean_frameshifts") * 5
    scored = scored.withColumn("combined_score", F.col("count_rank") + F.col("frameshift_rank")).withColumn(
        "severity_score", F.col("problem_count") * 2 + weight
    )
    if aggressive:
        scored = scored.withColumn("aggressive_score", F.col("_partners") * 3 + weight)
    return scored.drop("_partners")


def _offender_order(unit: str, aggressive: bool) -> list[Column]:
    # Sort keys of the offender lists.
    names = (
        ["aggressive_score", "problem_count", "total_frameshifts"]
        if aggressive
        else ["problem_count", "total_frameshifts", "mean_frameshifts"]
    )
    return [*[F.desc(n) for n in names], F.asc(unit)]


def top_offenders(scores: DataFrame, unit: str, n: int, aggressive: bool = False) -> DataFrame:
    return scores.orderBy(*_offender_order(unit, aggressive)).limit(n)


def recommend_drops(scores: DataFrame, unit: str, cutoff: float, aggressive: bool = False) -> DataFrame:
    """Units at or above the cutoff; if there is none, the ten worst.

    The aggressive form lowers the cutoff and adds the top fifth by frameshifts.
    """
    if aggressive:
        # Highest cutoff of the aggressive form.
        cutoff = min(cutoff, 0.10 if unit == "gene_id" else 0.05)
        q80 = exact_quantiles(scores.withColumn("_all", F.lit(1)), ["_all"], "total_frameshifts", {"q": 0.8})
        chosen = (F.col("problem_fraction") >= cutoff) | (
            F.col("total_frameshifts") >= q80.select("q").scalar()
        )
    else:
        chosen = F.col("problem_fraction") >= cutoff
    n_chosen = scores.agg(F.count_if(chosen)).scalar()
    worst = top_offenders(scores, unit, 10, aggressive).where(n_chosen == 0)
    return scores.where(chosen).unionByName(worst)


def filter_alignment_set(
    aln: DataFrame, allowed: DataFrame, omit: DataFrame, drop_genes: DataFrame
) -> DataFrame:
    """Sequences of allowed, not omitted accessions in genes that are not dropped."""
    return (
        aln.join(allowed.select("accession"), F.col("sequence_id") == F.col("accession"), "left_semi")
        .join(omit.select(F.col("accession").alias("sequence_id")), "sequence_id", "left_anti")
        .join(drop_genes.select(F.col("gene_id").alias("alignment")), "alignment", "left_anti")
    )


def unmatched_requests(aln: DataFrame, allowed: DataFrame, omit: DataFrame, drop_genes: DataFrame) -> DataFrame:
    """Omitted accessions that were not allowed and dropped genes that do not occur."""
    omits = omit.join(allowed, "accession", "left_anti").select(F.lit("omit").alias("request"), F.col("accession").alias("id"))
    genes = drop_genes.join(aln.select(F.col("alignment").alias("gene_id")), "gene_id", "left_anti")
    return omits.unionByName(genes.select(F.lit("drop_gene").alias("request"), F.col("gene_id").alias("id")))


def shared_genes(
    full: DataFrame, cohort: DataFrame, threshold: float, master: DataFrame, levels: list[str] | None = None
) -> DataFrame:
    """Master-list genes that are ``Single`` in enough genomes of the cohort.

    ``cohort`` has one row per genome with ``accession`` and ``assembly_level``.
    """
    used = cohort.where(F.col("assembly_level").isin(levels)) if levels else cohort
    n = used.agg(F.count(F.lit(1)).cast("double")).scalar()
    required = F.greatest(F.ceil(n * F.lit(float(threshold))), F.lit(1))
    return (
        full.where(F.col("status") == "Single")
        .join(used.select("accession"), "accession", "left_semi")
        .groupBy("gene")
        .agg(F.count(F.lit(1)).alias("n_single"))
        .where(F.col("n_single") >= required)
        .join(master.select("gene"), "gene", "left_semi")
    )


def cohort_levels(cohort: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Assembly level per accession, else that of the root's newest version."""
    from baseloom.functions.names import accession_root, accession_version

    newest = (
        assemblies.withColumn("root", accession_root(F.col("accession")))
        .groupBy("root")
        .agg(
            F.min(
                F.struct((-accession_version(F.col("accession"))).alias("v"), "accession", "assembly_level")
            ).alias("_b")
        )
        .select("root", F.col("_b.accession").alias("_newest"), F.col("_b.assembly_level").alias("assembly_level"))
    )
    return (
        cohort.withColumn("root", accession_root(F.col("accession")))
        .join(newest.select("root", "assembly_level"), "root", "left")
        .drop("root")
    )


def shared_genes_strict(full: DataFrame, cohort: DataFrame) -> DataFrame:
    """Genes that are ``Single`` in every genome of the cohort."""
    n = cohort.agg(F.countDistinct("accession")).scalar()
    return (
        full.where(F.col("status") == "Single")
        .join(cohort.select("accession"), "accession", "left_semi")
        .groupBy("gene")
        .agg(F.countDistinct("accession").alias("n_single"))
        .where(F.col("n_single") == n)
        .select("gene")
    )


def gather_unaligned(cds: DataFrame, genes: DataFrame, cohort: DataFrame) -> DataFrame:
    """Coding sequences of shared genes in the cohort, ready for one file per gene."""
    return cds.join(genes.select("gene"), "gene", "left_semi").join(cohort.select("accession"), "accession", "left_semi")


def gather_reference_others(
    cds: DataFrame, genes: DataFrame, reference: str, cohort: DataFrame, levels: list[str]
) -> DataFrame:
    """The reference's sequences, and those of others for genes the reference has."""
    wanted = cds.join(genes.select("gene"), "gene", "left_semi")
    ref = wanted.where(F.col("accession") == reference)
    allowed = cohort.where(F.col("assembly_level").isin(levels) & (F.col("accession") != reference))
    others = wanted.join(allowed.select("accession"), "accession", "left_semi").join(
        ref.select("gene"), "gene", "left_semi"
    )
    return ref.withColumn("role", F.lit("reference")).unionByName(others.withColumn("role", F.lit("other")))


def partitions(aln: DataFrame) -> DataFrame:
    """Column range of each gene in the joined matrix, genes in name order."""
    lengths = aln.groupBy("alignment").agg(F.max(F.length("seq")).cast("bigint").alias("length"))
    placed = running_total(lengths, ["alignment"], "length", "_before")
    return placed.select(
        "alignment",
        (F.col("_before") + 1).cast("bigint").alias("start"),
        (F.col("_before") + F.col("length")).cast("bigint").alias("end"),
    )


def concatenate(aln: DataFrame, parts: DataFrame) -> DataFrame:
    """Joined matrix as blocks per taxon: ``start, end`` and ``seq``, NULL for a gap.

    A run of missing genes is one gap block, found from the taxon's block
    before it, so no taxon-by-gene product is built and no matrix row is ever
    one value.
    """
    placed = aln.join(parts, "alignment").select("sequence_id", "alignment", "start", "end")
    taxon = Window.partitionBy("sequence_id").orderBy("start")
    width = parts.agg(F.max("end")).scalar()
    before = F.coalesce(F.lag("end").over(taxon), F.lit(0)) + 1
    gaps = placed.select("sequence_id", before.alias("_from"), (F.col("start") - 1).alias("_to"))
    tails = placed.groupBy("sequence_id").agg((F.max("end") + 1).alias("_from")).withColumn("_to", width)
    empty = gaps.unionByName(tails).where("_to >= _from").select(
        "sequence_id", F.col("_from").cast("bigint").alias("start"), F.col("_to").cast("bigint").alias("end"), F.lit(None).cast("string").alias("seq")
    )
    blocks = aln.join(parts, "alignment").select("sequence_id", "start", "end", "seq")
    return blocks.unionByName(empty)


def matrix_lines(blocks: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Blocks as text pieces of bounded width, gaps written out."""
    piece = F.least(F.col("end") - F.col("_at") + 1, F.lit(width)).cast("int")
    cut = F.when(F.col("seq").isNull(), F.repeat(F.lit("-"), piece)).otherwise(
        F.substring("seq", (F.col("_at") - F.col("start") + 1).cast("int"), piece)
    )
    spread_out = blocks.withColumn("_at", F.explode(F.sequence("start", "end", F.lit(width).cast("bigint"))))
    return spread_out.select("sequence_id", F.col("_at").alias("start"), cut.alias("text"))
