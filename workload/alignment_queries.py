"""Alignments: four-fold GC, cleaning, scores, shared genes, matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from baseloom.operators import alignments as A
from baseloom.session import stored
from workload import inputs as I
from workload.feature_queries import FULL_SQL, full_table
from workload.registry import query, rounded

_FOUR = "('GT', 'CC', 'AC', 'GC', 'GG', 'CT', 'CG', 'TC')"
N_CODONS = I.ALN_BP // 3


def detail_sql(same_family: bool) -> str:
    mixed = "cand AND NOT one" if same_family else "false"
    return f"""cod AS (SELECT alignment, sequence_id, i, substring(seq, i * 3 + 1, 3) AS c FROM (SELECT *, unnest(range(0, {N_CODONS})) AS i FROM aln)),
  per AS (SELECT alignment, i, bool_and(NOT regexp_matches(c[1], '[-!N]')) AS s1, bool_and(NOT regexp_matches(c[2], '[-!N]')) AS s2,
    bool_and(NOT regexp_matches(c[3], '[-!N]')) AS s3, bool_and(c[1:2] IN {_FOUR}) AS ff, count(DISTINCT c[1:2]) = 1 AS one
    FROM cod GROUP BY alignment, i),
  flags AS (SELECT *, cand AND NOT ({mixed}) AS kept, {mixed} AS mixed FROM (SELECT *, s1 AND s2 AND s3 AS complete, s1 AND s2 AND s3 AND ff AS cand FROM per)),
  counts AS (SELECT alignment, count(*) AS total_codons, sum(s1::INT + s2::INT + s3::INT)::BIGINT AS complete_sites_nt,
    count(*) FILTER (complete) AS complete_codons, count(*) FILTER (cand) AS candidate_gc4_codons_all_sequences,
    count(*) FILTER (mixed) AS dropped_mixed_gc4_family, count(*) FILTER (kept) AS retained_gc4_codons FROM flags GROUP BY alignment),
  whole AS (SELECT alignment, count(*) AS n_sequences_in_alignment, sum(length(seq) - length(replace(seq, '-', '')))::BIGINT AS invalid_char_gap,
    sum(length(seq) - length(replace(seq, '!', '')))::BIGINT AS invalid_char_frameshift,
    sum(length(seq) - length(replace(seq, 'N', '')))::BIGINT AS "invalid_char_N" FROM aln GROUP BY alignment),
  thirds AS (SELECT alignment, sequence_id, {", ".join(f"count(*) FILTER (kept AND c[3] = '{b}') AS {b.lower()}_gc4" for b in "GCATN")}
    FROM cod JOIN flags USING (alignment, i) GROUP BY alignment, sequence_id),
  detail AS (SELECT alignment, sequence_id, coalesce((g_gc4 + c_gc4) / nullif(CAST(g_gc4 + c_gc4 + a_gc4 + t_gc4 AS DOUBLE), 0), 0) AS gc4,
    g_gc4, c_gc4, a_gc4, t_gc4, n_gc4, g_gc4 + c_gc4 + a_gc4 + t_gc4 AS valid_gc4_bases, retained_gc4_codons AS retained_gc4_sites,
    retained_gc4_codons, n_sequences_in_alignment, {I.ALN_BP} AS alignment_length_nt, {I.ALN_BP} AS total_sites_nt, complete_sites_nt,
    {I.ALN_BP} - complete_sites_nt AS dropped_sites_incomplete_nt, total_codons, complete_codons,
    total_codons - complete_codons AS dropped_incomplete_codons, candidate_gc4_codons_all_sequences,
    complete_codons - candidate_gc4_codons_all_sequences AS dropped_not_gc4_all_sequences, dropped_mixed_gc4_family,
    'ok' AS status, invalid_char_gap, invalid_char_frameshift, "invalid_char_N"
    FROM thirds JOIN counts USING (alignment) JOIN whole USING (alignment))"""


@query("a09_gc4_alignment", f"WITH {I.ALN_SQL}, {detail_sql(False)} SELECT * REPLACE (round(gc4, 6) AS gc4) FROM detail")
def gc4_alignment(spark, d):
    return rounded(A.gc4_alignment(I.alignments(spark, d)))


@query("a09_gc4_same_family", f"WITH {I.ALN_SQL}, {detail_sql(True)} SELECT * REPLACE (round(gc4, 6) AS gc4) FROM detail")
def gc4_same_family(spark, d):
    return rounded(A.gc4_alignment(I.alignments(spark, d), same_family=True))


@query(
    "a10_validate_alignments",
    f"""WITH {I.DNA_SQL}, rows AS (SELECT doc_id // 2 AS k, bases FROM dna),
  a AS (SELECT 'pair_' || k AS alignment, CAST(min(length(bases)) AS BIGINT) AS min_length, CAST(max(length(bases)) AS BIGINT) AS max_length,
    count(*) FILTER (length(bases) % 3 <> 0) AS n_out_of_frame FROM rows GROUP BY k)
  SELECT *, array_to_string(list_filter([CASE WHEN min_length <> max_length THEN 'unequal_lengths' END,
    CASE WHEN n_out_of_frame > 0 THEN 'length_not_divisible_by_3' END], lambda x: x IS NOT NULL), ';') AS problem
  FROM a WHERE min_length <> max_length OR n_out_of_frame > 0""",
)
def validate(spark, d):
    pairs = I.dna(spark, d).select(
        F.concat(F.lit("pair_"), F.floor(F.col("doc_id") / 2).cast("bigint")).alias("alignment"), F.col("bases").alias("seq")
    )
    return A.validate_alignments(pairs)


@query(
    "a11_gc4_species",
    f"""WITH {I.ALN_SQL}, {detail_sql(False)} SELECT sequence_id, count(*) AS n_alignments,
  count(*) FILTER (valid_gc4_bases > 0) AS alignments_with_retained_gc4, {", ".join(f'sum("{c}")::BIGINT AS "{c}"' for c in A.SUMMED)},
  round(coalesce(sum(g_gc4 + c_gc4) / nullif(CAST(sum(valid_gc4_bases) AS DOUBLE), 0), 0), 6) AS gc4 FROM detail GROUP BY sequence_id""",
)
def gc4_species(spark, d):
    return rounded(A.gc4_species(A.gc4_alignment(I.alignments(spark, d))))


@query(
    "a12_gc4_mean",
    f"""WITH {I.ALN_SQL}, {detail_sql(False)} SELECT sequence_id AS genus_species, round(avg(gc4), 6) AS mean_gc4,
  round(stddev_samp(gc4), 6) AS sd_gc4, count(*) AS n_gc4_values FROM detail GROUP BY sequence_id""",
)
def gc4_mean(spark, d):
    detail = A.gc4_alignment(I.alignments(spark, d)).withColumnRenamed("sequence_id", "genus_species")
    return rounded(A.gc4_mean(detail))


FS_SQL = """fs AS (SELECT alignment AS gene_id, sequence_id AS accession, CAST(length(seq) - length(replace(seq, '!', '')) AS BIGINT) AS frameshifts,
  length(seq) - length(replace(seq, '!', '')) > 0 AS sequence_filtered FROM aln)"""


@query("a20_frameshifts", f"WITH {I.ALN_SQL}, {FS_SQL} SELECT * FROM fs")
def frameshifts(spark, d):
    return A.frameshifts(I.alignments(spark, d), 0)


_OCC = f"""{I.ALN_SQL}, {FS_SQL}, occ AS (SELECT gene_id, count(*) FILTER (NOT sequence_filtered) AS n_clean FROM fs GROUP BY gene_id)"""


@query(
    "a21_clean_alignments",
    f"""WITH {_OCC} SELECT alignment, sequence_id, replace(seq, '!', '-') AS seq FROM aln JOIN fs ON gene_id = alignment
  AND accession = sequence_id WHERE NOT sequence_filtered AND alignment IN (SELECT gene_id FROM occ WHERE n_clean / 3.0::DOUBLE >= 0.6::DOUBLE)""",
)
def clean_alignments(spark, d):
    return A.clean_alignments(I.alignments(spark, d), 0, I.ALN_DOCS, 0.6)


@query(
    "a21_cleaning_summary",
    f"""WITH {_OCC} SELECT 0.6::DOUBLE AS threshold, CAST(0 AS BIGINT) AS errors, count(*) AS total_genes_analyzed,
  count(*) FILTER (n_clean / 3.0::DOUBLE < 0.6::DOUBLE) AS genes_dropped, count(*) FILTER (n_clean / 3.0::DOUBLE >= 0.6::DOUBLE) AS genes_retained FROM occ""",
)
def cleaning_summary(spark, d):
    return A.cleaning_summary(I.alignments(spark, d), 0, I.ALN_DOCS, 0.6)


@query("a21_dropped_genes", f"WITH {_OCC} SELECT gene_id AS alignment FROM occ WHERE n_clean / 3.0::DOUBLE < 0.6::DOUBLE")
def dropped_genes(spark, d):
    return A.dropped_genes(I.alignments(spark, d), 0, I.ALN_DOCS, 0.6)


def scores_sql(unit: str, partner: str) -> str:
    return f"""scores AS (SELECT *, dense_rank() OVER (ORDER BY problem_count DESC) AS count_rank,
    dense_rank() OVER (ORDER BY total_frameshifts DESC) AS frameshift_rank,
    dense_rank() OVER (ORDER BY problem_count DESC) + dense_rank() OVER (ORDER BY total_frameshifts DESC) AS combined_score,
    problem_count * 2 + total_frameshifts + mean_frameshifts * 5 AS severity_score,
    partners * 3 + total_frameshifts + mean_frameshifts * 5 AS aggressive_score
  FROM (SELECT {unit}, count(*) AS problem_count, sum(frameshifts)::BIGINT AS total_frameshifts, avg(frameshifts) AS mean_frameshifts,
    count(DISTINCT {partner}) AS partners, count(*) / CAST((SELECT count(DISTINCT {partner}) FROM fs) AS DOUBLE) AS problem_fraction
    FROM fs WHERE sequence_filtered GROUP BY {unit}))"""


_ROUND = "round(mean_frameshifts, 6) AS mean_frameshifts, round(problem_fraction, 6) AS problem_fraction, round(severity_score, 6) AS severity_score, round(aggressive_score, 6) AS aggressive_score"


def _scores(spark, d, unit):
    return A.score_problems(A.frameshifts(I.alignments(spark, d), 0), unit, aggressive=True)


for _unit, _partner in (("gene_id", "accession"), ("accession", "gene_id")):
    _sql = f"WITH {I.ALN_SQL}, {FS_SQL}, {scores_sql(_unit, _partner)} SELECT * EXCLUDE (partners) REPLACE ({_ROUND}) FROM scores"

    @query(f"a22_problem_scores_{_unit}", _sql)
    def problem_scores(spark, d, unit=_unit):
        return rounded(_scores(spark, d, unit))

    @query(
        f"t02_top_offenders_{_unit}",
        _sql + f" ORDER BY scores.aggressive_score DESC, problem_count DESC, total_frameshifts DESC, {_unit} LIMIT 25",
    )
    def top_offenders(spark, d, unit=_unit):
        return rounded(A.top_offenders(stored(_scores(spark, d, unit)), unit, 25, aggressive=True))

    @query(
        f"a23_recommend_drops_{_unit}",
        _sql
        + f""" WHERE scores.problem_fraction >= {0.1 if _unit == 'gene_id' else 0.05}::DOUBLE
  OR total_frameshifts >= (SELECT quantile_cont(total_frameshifts, 0.8::DOUBLE) FROM scores)""",
    )
    def recommend(spark, d, unit=_unit):
        return rounded(A.recommend_drops(stored(_scores(spark, d, unit)), unit, 0.3, aggressive=True))


@query(
    "a23_recommend_fallback",
    f"""WITH {I.ALN_SQL}, {FS_SQL}, {scores_sql('accession', 'gene_id')} SELECT accession, problem_count FROM scores
  ORDER BY problem_count DESC, total_frameshifts DESC, mean_frameshifts DESC, accession LIMIT 10""",
)
def recommend_fallback(spark, d):
    scores = stored(A.score_problems(A.frameshifts(I.alignments(spark, d), 0), "accession"))
    return A.recommend_drops(scores, "accession", 1.01).select("accession", "problem_count")


def _sets(spark, d):
    aln = I.alignments(spark, d)
    taxa = I.table(spark, d, "documents").select((F.col("doc_id") % 60).alias("k")).distinct()
    name = F.concat(F.lit("taxon"), "k")
    allowed = taxa.where(F.col("k") % 7 != 3).select(name.alias("accession"))
    omit = taxa.where(F.col("k") % 5 == 3).select(name.alias("accession"))
    genes = aln.select(F.col("alignment").alias("gene_id")).distinct()
    drop = genes.where(F.col("gene_id").endswith("_0")).unionByName(
        I.table(spark, d, "region").select(F.concat(F.lit("none_"), "r_regionkey").alias("gene_id"))
    )
    return aln, allowed, omit, drop


_SETS = f"""{I.ALN_SQL}, taxa AS (SELECT DISTINCT doc_id % 60 AS k FROM documents), allowed AS (SELECT 'taxon' || k AS accession FROM taxa WHERE k % 7 <> 3),
  omit AS (SELECT 'taxon' || k AS accession FROM taxa WHERE k % 5 = 3),
  drops AS (SELECT DISTINCT alignment AS gene_id FROM aln WHERE suffix(alignment, '_0') UNION ALL SELECT 'none_' || r_regionkey FROM region)"""


@query(
    "f06_filter_alignment_set",
    f"""WITH {_SETS} SELECT * FROM aln WHERE sequence_id IN (SELECT accession FROM allowed)
  AND sequence_id NOT IN (SELECT accession FROM omit) AND alignment NOT IN (SELECT gene_id FROM drops)""",
)
def filter_set(spark, d):
    return A.filter_alignment_set(*_sets(spark, d))


@query(
    "f06_unmatched_requests",
    f"""WITH {_SETS} SELECT 'omit' AS request, accession AS id FROM omit WHERE accession NOT IN (SELECT accession FROM allowed)
  UNION ALL SELECT 'drop_gene', gene_id FROM drops WHERE gene_id NOT IN (SELECT alignment FROM aln)""",
)
def unmatched(spark, d):
    return A.unmatched_requests(*_sets(spark, d))


def single_table(spark, d):
    """One status per genome and gene: the best one seen."""
    return full_table(spark, d).groupBy("accession", "gene").agg(F.max("status").alias("status"))


SINGLE_SQL = FULL_SQL + ", single_table AS (SELECT accession, gene, max(status) AS status FROM full_table GROUP BY ALL)"


def _cohort(spark, d):
    k = F.col("l_suppkey") % 40
    return (
        I.table(spark, d, "lineitem")
        .select(k.alias("k"))
        .distinct()
        .select(
            F.concat(F.lit("GCA_"), "k").alias("accession"),
            F.when(F.col("k") % 3 == 0, "Scaffold").otherwise("Chromosome").alias("assembly_level"),
        )
    )


_COHORT = "cohort AS (SELECT 'GCA_' || k AS accession, CASE WHEN k % 3 = 0 THEN 'Scaffold' ELSE 'Chromosome' END AS assembly_level FROM (SELECT DISTINCT l_suppkey % 40 AS k FROM lineitem))"


def _master(spark, d):
    return I.table(spark, d, "part").where(F.col("p_size") < 40).select(F.concat(F.lit("g"), "p_partkey").alias("gene"))


@query(
    "a18_shared_genes",
    f"""WITH {SINGLE_SQL}, {_COHORT} SELECT gene, count(*) AS n_single FROM single_table WHERE status = 'Single'
  AND accession IN (SELECT accession FROM cohort WHERE assembly_level = 'Chromosome')
  AND gene IN (SELECT 'g' || p_partkey FROM part WHERE p_size < 40) GROUP BY gene
  HAVING count(*) >= greatest(1, ceil((SELECT count(*) FROM cohort WHERE assembly_level = 'Chromosome') * 0.3::DOUBLE))""",
)
def shared_genes(spark, d):
    return A.shared_genes(single_table(spark, d), _cohort(spark, d), 0.3, _master(spark, d), ["Chromosome"])


_STRICT = "SELECT gene FROM single_table WHERE status = 'Single' AND accession IN (SELECT accession FROM few) GROUP BY gene HAVING count(DISTINCT accession) = (SELECT count(*) FROM few)"


@query(
    "a19_shared_genes_strict",
    f"WITH {SINGLE_SQL}, {_COHORT}, few AS (SELECT accession FROM cohort WHERE accession IN ('GCA_1', 'GCA_2')) {_STRICT}",
)
def shared_strict(spark, d):
    few = _cohort(spark, d).where(F.col("accession").isin("GCA_1", "GCA_2"))
    return A.shared_genes_strict(single_table(spark, d), few)


_LABELLED = "labelled AS (SELECT 'GCA_' || (doc_id % 40) AS accession, 'g' || piece AS gene, gene AS id, seq FROM cds)"


def _labelled(spark, d):
    return I.cds(spark, d).select(
        F.concat(F.lit("GCA_"), F.col("doc_id") % 40).alias("accession"), F.concat(F.lit("g"), "piece").alias("gene"), F.col("gene").alias("id"), "seq"
    )


@query(
    "a32_gather_unaligned",
    f"""WITH {I.CDS_SQL}, {_LABELLED}, {SINGLE_SQL}, {_COHORT}, few AS (SELECT accession FROM cohort WHERE accession IN ('GCA_1', 'GCA_2'))
  SELECT * FROM labelled WHERE gene IN ({_STRICT}) AND accession IN (SELECT accession FROM cohort WHERE assembly_level = 'Chromosome')""",
)
def gather(spark, d):
    cohort = _cohort(spark, d)
    genes = A.shared_genes_strict(single_table(spark, d), cohort.where(F.col("accession").isin("GCA_1", "GCA_2")))
    return A.gather_unaligned(_labelled(spark, d), genes, cohort.where("assembly_level = 'Chromosome'"))


@query(
    "a32b_gather_ref_others",
    f"""WITH {I.CDS_SQL}, {_LABELLED}, {_COHORT}, wanted AS (SELECT * FROM labelled WHERE gene IN (SELECT 'g' || p_partkey FROM part WHERE p_size < 40))
  SELECT *, 'reference' AS role FROM wanted WHERE accession = 'GCA_4' UNION ALL SELECT *, 'other' FROM wanted WHERE accession <> 'GCA_4'
  AND accession IN (SELECT accession FROM cohort WHERE assembly_level = 'Chromosome') AND gene IN (SELECT gene FROM wanted WHERE accession = 'GCA_4')""",
)
def gather_ref(spark, d):
    return A.gather_reference_others(_labelled(spark, d), _master(spark, d), "GCA_4", _cohort(spark, d), ["Chromosome"])


_PARTS = """parts AS (SELECT alignment, sum(n) OVER (ORDER BY alignment) - n + 1 AS "start", sum(n) OVER (ORDER BY alignment) AS "end"
  FROM (SELECT alignment, max(length(seq)) AS n FROM aln GROUP BY alignment))"""


@query("a33_partitions", f'WITH {I.ALN_SQL}, {_PARTS} SELECT alignment, "start"::BIGINT AS "start", "end"::BIGINT AS "end" FROM parts')
def partitions(spark, d):
    return A.partitions(I.alignments(spark, d))


_BLOCKS = f"""{I.ALN_SQL}, {_PARTS}, placed AS (SELECT sequence_id, seq, "start" AS s, "end" AS e, lag("end", 1, 0) OVER (PARTITION BY sequence_id ORDER BY "start") AS b
    FROM aln JOIN parts USING (alignment)), tails AS (SELECT sequence_id, max(e) AS b, (SELECT max("end") FROM parts) AS w FROM placed GROUP BY sequence_id),
  blocks AS (SELECT sequence_id, s, e, seq FROM placed UNION ALL SELECT sequence_id, b + 1, s - 1, NULL FROM placed WHERE s > b + 1
    UNION ALL SELECT sequence_id, b + 1, w, NULL FROM tails WHERE b < w)"""


@query("a33_concatenate", f'WITH {_BLOCKS} SELECT sequence_id, s::BIGINT AS "start", e::BIGINT AS "end", seq FROM blocks')
def concatenate(spark, d):
    aln = I.alignments(spark, d)
    return A.concatenate(aln, stored(A.partitions(aln)))


@query(
    "a33_matrix_lines",
    f"""WITH {_BLOCKS}, cut AS (SELECT sequence_id, s, e, seq, unnest(range(s::BIGINT, e::BIGINT + 1, 5000)) AS pos FROM blocks)
  SELECT sequence_id, pos AS "start", md5(coalesce(substring(seq, (pos - s + 1)::BIGINT, 5000), repeat('-', least(e - pos + 1, 5000)::BIGINT))) AS digest FROM cut""",
)
def matrix_lines(spark, d):
    aln = I.alignments(spark, d)
    lines = A.matrix_lines(A.concatenate(aln, stored(A.partitions(aln))), 5000)
    return lines.select("sequence_id", "start", F.md5("text").alias("digest"))
