"""Coding sequences, introns, flanks and their summaries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from baseloom.functions import kernels as K
from baseloom.functions import sequence as S
from baseloom.operators import features as FT
from baseloom.operators import intervals as IV
from baseloom.operators.ranking import assign_pk
from baseloom.session import stored
from workload import inputs as I
from workload.registry import ORACLES, query, rounded

C = I.SLICE_BP
REVCOMP = f"reverse(translate({{0}}, '{K.IUPAC}', '{K.IUPAC_COMPLEMENT}'))"


def gc_sql(s: str) -> str:
    n = f"(length({s}) - length(translate({s}, 'ACGT', '')))"
    return f"CAST(length({s}) - length(translate({s}, 'GC', '')) AS DOUBLE) / nullif({n}, 0)"


CODONS = "list_transform(range(0, length({0}) // 3), lambda i: substring({0}, i * 3 + 1, 3))"
STOPS = "['TAA', 'TAG', 'TGA']"
OPEN = f"CASE WHEN list_contains({STOPS}, right(seq, 3)) THEN left(seq, length(seq) - 3) ELSE seq END"
INNER = f"len(list_filter({CODONS.format('seq')}[1:greatest(length(seq) // 3 - 1, 0)], lambda c: list_contains({STOPS}, c)))"
THIRDS = f"array_to_string(list_transform({CODONS.format('op')}, lambda c: c[3]), '')"
FOUR = (
    f"array_to_string(list_transform(list_filter({CODONS.format('op')}, lambda c: c[1:2] IN "
    "('GT', 'CC', 'AC', 'GC', 'GG', 'CT', 'CG', 'TC')), lambda c: c[3]), '')"
)


def composition_sql(source: str, columns: str) -> str:
    return f"""SELECT {columns}, {gc_sql('seq')} AS gc,
  CASE WHEN length(seq) % 3 = 0 AND inner_stops = 0 THEN {gc_sql('t3')} END AS gc3,
  CASE WHEN length(op) % 3 = 0 THEN {gc_sql('t4')} END AS gc4
  FROM (SELECT *, {THIRDS} AS t3, {FOUR} AS t4 FROM (SELECT *, {OPEN} AS op, {INNER} AS inner_stops FROM {source}))"""


@query(
    "p13_cds_composition",
    f"""WITH {I.CDS_SQL} SELECT gene, round(gc, 6) AS gc, round(gc3, 6) AS gc3, round(gc4, 6) AS gc4
  FROM ({composition_sql('cds', 'gene')})""",
)
def cds_composition(spark, d):
    return rounded(FT.cds_composition(I.cds(spark, d)).select("gene", "gc", "gc3", "gc4"))


@query(
    "p14_base_counts",
    f"""WITH {I.DNA_SQL} SELECT doc_id, length(bases) - length(replace(bases, 'A', '')) AS a_count,
  length(bases) - length(replace(bases, 'C', '')) AS c_count, length(bases) - length(replace(bases, 'G', '')) AS g_count,
  length(bases) - length(replace(bases, 'T', '')) AS t_count, length(bases) - length(replace(bases, 'N', '')) AS n_count,
  CAST(0 AS BIGINT) AS gap_bp, CAST(0 AS BIGINT) AS other_count,
  length(bases) - length(translate(bases, 'ACGT', '')) AS callable_bp,
  length(bases) - length(translate(bases, 'GC', '')) AS gc_bp, round({gc_sql('bases')}, 6) AS gc_prop FROM dna""",
)
def base_counts(spark, d):
    wanted = ("other_count", "callable_bp", "gc_bp", "gc_prop")
    df = S.with_base_counts(I.dna(spark, d), F.col("bases"))
    derived = S.derived_count_columns()
    return rounded(df.withColumns({n: derived[n] for n in wanted}).drop("bases", "total_bp"))


QC_SQL = f"""qc AS (SELECT *, sequence_length % 3 = 0 AS passes_length_mod_3,
    internal_stop_count = 0 AS passes_internal_stop_check, invalid_count = 0 AS passes_invalid_base_check,
    (sequence_length % 3 = 0 AND internal_stop_count = 0 AND invalid_count = 0) AS passes_raw_cds_qc
  FROM (SELECT doc_id, piece, accession, gene, seq, length(seq) AS sequence_length, length(seq) % 3 AS length_mod_3,
    {INNER} AS internal_stop_count,
    coalesce(list_contains({STOPS}, ({CODONS.format('seq')})[-1]), false) AS terminal_stop,
    (length(seq) - CASE WHEN coalesce(list_contains({STOPS}, ({CODONS.format('seq')})[-1]), false) THEN 3 ELSE 0 END) // 3 AS protein_length,
    length(seq) - length(replace(seq, 'N', '')) AS n_count, length(seq) - length(replace(seq, 'N', '')) AS ambiguous_count,
    length(seq) - length(translate(seq, 'ACGT', '')) AS total_valid_bases,
    length(translate(seq, 'ACGTN', '')) AS invalid_count FROM raw))"""
# Every 13th piece carries a character that is no base.
RAW_SQL = I.CDS_SQL + ", raw AS (SELECT * REPLACE (CASE WHEN piece % 13 = 12 THEN replace(seq, 'AC', 'A?') ELSE seq END AS seq) FROM cds)"


def raw_cds(spark, d):
    odd = F.replace("seq", F.lit("AC"), F.lit("A?"))
    return I.cds(spark, d).withColumn("seq", F.when(F.col("piece") % 13 == 12, odd).otherwise(F.col("seq")))


@query(
    "p15_cds_quality",
    f"""WITH {RAW_SQL}, {QC_SQL} SELECT accession, gene, sequence_length, length_mod_3, internal_stop_count, terminal_stop,
  protein_length, n_count, ambiguous_count, round(CAST(ambiguous_count AS DOUBLE) / sequence_length, 6) AS ambiguous_fraction,
  invalid_count, total_valid_bases, passes_length_mod_3, passes_internal_stop_check, passes_invalid_base_check,
  passes_raw_cds_qc, CASE WHEN passes_raw_cds_qc THEN 'pass' ELSE array_to_string(list_filter([
    CASE WHEN NOT passes_length_mod_3 THEN 'length_not_divisible_by_3' END,
    CASE WHEN NOT passes_internal_stop_check THEN 'internal_stop_codons' END,
    CASE WHEN NOT passes_invalid_base_check THEN 'invalid_characters' END], lambda x: x IS NOT NULL), ';') END AS failure_reasons
  FROM qc""",
)
def cds_quality(spark, d):
    drop = ["doc_id", "piece", "a_count", "t_count", "g_count", "c_count", "invalid_fraction"]
    return rounded(FT.cds_quality(raw_cds(spark, d)).drop(*drop))


@query(
    "a05_cds_quality_summary",
    f"""WITH {RAW_SQL}, {QC_SQL} SELECT accession, grouping(accession) = 1 AS is_total, count(*) AS total_sequences,
  count(*) FILTER (passes_raw_cds_qc) AS passed_raw_cds_qc, count(*) FILTER (NOT passes_raw_cds_qc) AS failed_raw_cds_qc,
  count(*) FILTER (NOT passes_length_mod_3) AS failed_length_mod_3_check,
  count(*) FILTER (NOT passes_internal_stop_check) AS failed_internal_stop_check,
  count(*) FILTER (NOT passes_invalid_base_check) AS failed_invalid_base_check,
  count(*) FILTER (terminal_stop) AS sequences_with_terminal_stop_codon FROM qc GROUP BY ROLLUP (accession)""",
)
def cds_quality_summary(spark, d):
    return FT.cds_quality_summary(FT.cds_quality(raw_cds(spark, d)))


@query(
    "p16_translate_cds",
    f"""WITH {I.CDS_SQL}, code AS (SELECT a || b || c AS codon, substring('{S.STANDARD_CODE}', i * 16 + j * 4 + k + 1, 1) AS aa
    FROM (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) x(a, i), (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) y(b, j),
      (VALUES ('T', 0), ('C', 1), ('A', 2), ('G', 3)) z(c, k)),
  parts AS (SELECT gene, seq, i, substring(seq, i * 3 + 1, 3) AS codon FROM (SELECT gene, seq, unnest(range(0, length(seq) // 3)) AS i FROM cds))
  SELECT cds.gene, coalesce(p.protein, '') AS protein FROM cds LEFT JOIN (SELECT gene,
    string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS protein FROM parts LEFT JOIN code USING (codon) GROUP BY gene) p USING (gene)""",
)
def translate(spark, d):
    return I.cds(spark, d).select("gene", S.translate_dna(F.col("seq")).alias("protein"))


@query(
    "p17_reverse_complement",
    f"""SELECT doc_id, md5({REVCOMP.format("regexp_replace(text, '[^A-Za-z]', '', 'g')")}) AS rc FROM documents""",
)
def revcomp(spark, d):
    text = F.regexp_replace("text", "[^A-Za-z]", "")
    return I.table(spark, d, "documents").select("doc_id", F.md5(S.reverse_complement(text)).alias("rc"))


_SLICED = f"""{I.DNA_SQL}, {I.MODELS_SQL}"""


@query(
    "j09_slice_intervals",
    f"""WITH {_SLICED} SELECT gene, genome_pk, CASE WHEN strand = '-' THEN {REVCOMP.format('s')} ELSE s END AS seq
  FROM (SELECT gene, genome_pk, strand, substring(bases, "start", "end" - "start" + 1) AS s
    FROM models JOIN dna USING (doc_id) WHERE bases <> '')""",
)
def slice_intervals(spark, d, models=I.models):
    return IV.slice_intervals(I.chunk_store(spark, d, C), models(spark, d), C, ["genome_pk", "gene"]).select(
        "gene", "genome_pk", "seq"
    )


CDS_OF_GENES = f"""gene_cds AS (SELECT genome_pk, gene, sequence_id, strand,
    CASE WHEN strand = '-' THEN {REVCOMP.format('s')} ELSE s END AS seq
  FROM (SELECT genome_pk, gene, sequence_id, strand,
      string_agg(substring(bases, e."start", e."end" - e."start" + 1), '' ORDER BY e."start", e."end") AS s
    FROM models m JOIN exons e USING (gene_no, doc_id) JOIN dna USING (doc_id)
    WHERE status = 'Single' AND bases <> '' GROUP BY genome_pk, gene, sequence_id, strand))"""


@query("j10_extract_cds", f"WITH {_SLICED}, {CDS_OF_GENES} SELECT * FROM gene_cds")
def extract_cds(spark, d, models=I.models):
    return IV.extract_cds(models(spark, d), I.chunk_store(spark, d, C), C)


INTRONS_SQL = """introns AS (SELECT genome_pk, gene, sequence_id, doc_id, status, strand, s AS "start", e AS "end", e - s + 1 AS length,
    row_number() OVER w AS intron_no, 'i_' || gene || '_' || (row_number() OVER w) AS intron_id
  FROM (SELECT gene_no, doc_id, "end" + 1 AS s, lead("start") OVER (PARTITION BY gene_no ORDER BY "start", "end") - 1 AS e FROM exons)
  JOIN models USING (gene_no, doc_id) WHERE s <= e
  WINDOW w AS (PARTITION BY gene ORDER BY CASE WHEN strand = '-' THEN -s ELSE s END))"""


@query(
    "w05_infer_introns",
    f"""WITH {I.MODELS_SQL}, {INTRONS_SQL} SELECT gene, intron_id, intron_no, strand, "start", "end", length FROM introns""",
)
def infer_introns(spark, d, models=I.models):
    return IV.infer_introns(models(spark, d)).select("gene", "intron_id", "intron_no", "strand", "start", "end", "length")


INTRON_SEQ = f"""intron_seq AS (SELECT i.*, CASE WHEN strand = '-' THEN {REVCOMP.format('p')} ELSE p END AS seq
  FROM (SELECT introns.*, substring(bases, "start", "end" - "start" + 1) AS p FROM introns JOIN dna USING (doc_id)
    WHERE bases <> '') i)"""


@query(
    "j11_extract_introns",
    f"""WITH {_SLICED}, {INTRONS_SQL}, {INTRON_SEQ} SELECT genome_pk, intron_id, "start", "end", length, seq,
  length(seq) - length(replace(seq, 'A', '')) AS a_count, length(seq) - length(replace(seq, 'C', '')) AS c_count,
  length(seq) - length(replace(seq, 'G', '')) AS g_count, length(seq) - length(replace(seq, 'T', '')) AS t_count,
  length(seq) - length(replace(seq, 'N', '')) AS n_count, length(seq) - length(translate(seq, 'ACGT', '')) AS total_valid_bases,
  round(coalesce({gc_sql('seq')}, 0), 6) AS gc FROM intron_seq WHERE status = 'Single'""",
)
def extract_introns(spark, d, models=I.models):
    introns = IV.infer_introns(models(spark, d).where("status = 'Single'"))
    out = IV.extract_introns(introns, I.chunk_store(spark, d, C), C)
    return rounded(out.drop("sequence_id", "gene", "status", "strand", "intron_no"))


FLANKS_SQL = f"""flank_at AS (SELECT m.*, k AS flank_set_pk, bases,
    CASE WHEN strand = '+' THEN greatest(1, "start" - b) ELSE "end" + 1 END AS up_start,
    CASE WHEN strand = '+' THEN "start" - 1 ELSE "end" + b END AS up_end,
    CASE WHEN strand = '+' THEN "end" + 1 ELSE greatest(1, "start" - b) END AS down_start,
    CASE WHEN strand = '+' THEN "end" + b ELSE "start" - 1 END AS down_end
  FROM models m JOIN dna USING (doc_id), (VALUES (CAST(1 AS BIGINT), 50), (2, 100), (3, 200)) f(k, b) WHERE bases <> ''),
  flanks AS (SELECT *, {gc_sql("(u || w)")} AS gc, length(u || w) - length(translate(u || w, 'ACGT', '')) AS length,
    {gc_sql('u')} AS upstream_gc, {gc_sql('w')} AS downstream_gc
  FROM (SELECT * EXCLUDE (bases), substring(bases, up_start, greatest(up_end - up_start + 1, 0)) AS u,
    substring(bases, down_start, greatest(down_end - down_start + 1, 0)) AS w FROM flank_at))"""


@query(
    "j12_extract_flanks",
    f"""WITH {_SLICED}, {FLANKS_SQL} SELECT genome_pk, gene, flank_set_pk, up_start, up_end, down_start, down_end,
  round(gc, 6) AS gc, length, round(upstream_gc, 6) AS upstream_gc, round(downstream_gc, 6) AS downstream_gc FROM flanks""",
)
def extract_flanks(spark, d, models=I.models):
    out = IV.extract_flanks(models(spark, d), I.chunk_store(spark, d, C), C)
    return rounded(out.drop("sequence_id", "status", "strand", "start", "end"))


def reported_introns(spark, d, models=I.models):
    """Introns as a file may report them: some with a wrong length or base."""
    introns = IV.infer_introns(models(spark, d))
    cut = IV.cut_spans(I.chunk_store(spark, d, C), introns, C, {"seq": (F.col("start"), F.col("end"))})
    return (
        cut.withColumn("seq", S.orient(F.col("seq"), F.col("strand")))
        .withColumn("length", F.when(F.col("start") % 10 == 0, F.col("length") + 1).otherwise(F.col("length")))
        .withColumn("seq", F.when(F.col("start") % 9 == 0, F.concat(F.lit("N"), F.substring("seq", 2, 1 << 20))).otherwise(F.col("seq")))
    )


REPORTED = f"""checked AS (SELECT genome_pk, intron_id, "start", "end", strand, bases,
    length + CASE WHEN "start" % 10 = 0 THEN 1 ELSE 0 END AS reported_length, length AS expected_length,
    CASE WHEN "start" % 9 = 0 THEN 'N' || substring(seq, 2) ELSE seq END AS got, seq AS want FROM intron_seq JOIN dna USING (doc_id))"""


@query(
    "j13_validate_introns",
    f"""WITH {_SLICED}, {INTRONS_SQL}, {INTRON_SEQ}, {REPORTED} SELECT genome_pk, intron_id, reported_length, expected_length,
  length(got) AS reported_sequence_length, reported_length = expected_length AS length_math_ok,
  length(got) = expected_length AS sequence_length_match, got = want AS sequence_match, left(got, 20) AS reported_first_20,
  left(want, 20) AS expected_first_20, right(got, 20) AS reported_last_20, right(want, 20) AS expected_last_20,
  substring(bases, greatest(1, "start" - 5), "start" + 4 - greatest(1, "start" - 5) + 1) AS left_boundary_sequence,
  substring(bases, greatest(1, "end" - 4), "end" + 5 - greatest(1, "end" - 4) + 1) AS right_boundary_sequence FROM checked""",
)
def validate_introns(spark, d, models=I.models):
    return IV.validate_introns(reported_introns(spark, d, models), I.chunk_store(spark, d, C), C, boundary=5)


@query(
    "j13_validation_summary",
    f"""WITH {_SLICED}, {INTRONS_SQL}, {INTRON_SEQ}, {REPORTED} SELECT count(*) AS n_checked,
  count(*) FILTER (got = want) AS n_sequence_match, count(*) FILTER (reported_length = expected_length) AS n_length_math_ok,
  count(*) FILTER (length(got) = expected_length) AS n_sequence_length_match, count(*) FILTER (got <> want) AS n_mismatch FROM checked""",
)
def validation_summary(spark, d, models=I.models):
    return IV.validation_summary(IV.validate_introns(reported_introns(spark, d, models), I.chunk_store(spark, d, C), C))


def orthologs(spark, d, models_of=I.models):
    """Quality, sequences and models of all genes; some genes lack one of them."""
    # Three steps start from the models and two from the sequences: both are formed once.
    models = stored(models_of(spark, d))
    cds = stored(IV.extract_cds(models, I.chunk_store(spark, d, C), C))
    number = F.substring("gene", 2, 20).cast("bigint")
    quality = FT.cds_quality(cds.where(number % 9 != 4)).where("passes_raw_cds_qc IS NOT NULL")
    return stored(FT.assemble_orthologs(quality, cds.where(number % 9 != 5), models.where(number % 9 != 6)))


ORTHOLOGS_SQL = f"""{_SLICED}, {CDS_OF_GENES}, raw AS (SELECT genome_pk, gene, seq, CAST(substring(gene, 2) AS BIGINT) AS k FROM gene_cds),
  flags AS (SELECT genome_pk, gene, (length(seq) % 3 = 0 AND {INNER} = 0 AND length(translate(seq, 'ACGTN', '')) = 0) AS ok FROM raw WHERE k % 9 <> 4),
  ids AS (SELECT genome_pk, gene FROM flags UNION SELECT genome_pk, gene FROM raw WHERE k % 9 <> 5
    UNION SELECT genome_pk, gene FROM models WHERE gene_no % 9 <> 6),
  joined AS (SELECT genome_pk, gene, m.sequence_id, m.status, m.strand, m."start", m."end", coalesce(ok, false) AS passes_raw_cds_qc,
    CASE WHEN coalesce(ok, false) AND r.seq <> '' THEN r.seq END AS seq
    FROM ids LEFT JOIN flags USING (genome_pk, gene) LEFT JOIN (SELECT * FROM raw WHERE k % 9 <> 5) r USING (genome_pk, gene)
    LEFT JOIN (SELECT * FROM models WHERE gene_no % 9 <> 6) m USING (genome_pk, gene)),
  orthologs AS ({composition_sql('joined', 'genome_pk, gene, sequence_id, status, strand, "start", "end", passes_raw_cds_qc, length(seq) AS length')})"""


@query(
    "j03_assemble_orthologs",
    f"""WITH {ORTHOLOGS_SQL} SELECT * REPLACE (round(gc, 6) AS gc, round(gc3, 6) AS gc3, round(gc4, 6) AS gc4) FROM orthologs""",
)
def assemble_orthologs(spark, d, models=I.models):
    return rounded(orthologs(spark, d, models))


@query(
    "j04_attach_sequence_pk",
    f"""WITH {I.SEQS_SQL}, {I.MODELS_SQL} SELECT m.gene, s.sequence_pk FROM models m LEFT JOIN seqs s
  ON s.genome_pk = m.genome_pk AND s.sequence_id = m.sequence_id AND s.sequence_pk % 5 <> 0""",
)
def attach_sequence_pk(spark, d):
    known = I.seqs(spark, d).where(F.col("sequence_pk") % 5 != 0)
    return FT.attach_sequence_pk(I.models(spark, d), known).select("gene", "sequence_pk")


def _stats_sql(name: str, value: str, weight: str) -> str:
    q = {f"q{p:02d}_{name}": f"quantile_cont({value}, {p / 100}::DOUBLE)" for p in (5, 25, 75, 95)}
    out = {
        f"mean_{name}": f"avg({value})",
        f"weighted_mean_{name}": f"sum({value} * {weight}) / sum(CASE WHEN {value} IS NOT NULL AND {weight} > 0 THEN {weight} END)",
        f"sd_{name}": f"stddev_samp({value})",
        f"var_{name}": f"var_samp({value})",
        f"median_{name}": f"median({value})",
        f"mad_{name}": f"mad({value})",
        f"iqr_{name}": f"quantile_cont({value}, 0.75::DOUBLE) - quantile_cont({value}, 0.25::DOUBLE)",
        **q,
    }
    return out


def _select_stats(parts: dict[str, str]) -> str:
    return ", ".join(f"round({e}, 6) AS {n}" for n, e in parts.items())


_ORTHO_STATS = {}
for _m in ("gc", "gc3", "gc4"):
    _ORTHO_STATS.update({k: v for k, v in _stats_sql(_m, _m, "length").items() if _m == "gc3" or not k.startswith("q")})


@query(
    "a06_ortholog_summary",
    f"""WITH {ORTHOLOGS_SQL} SELECT genome_pk, count(*) AS n_orthologs, sum(length)::BIGINT AS callable_bp_total,
  round(avg(length), 6) AS mean_ortholog_length, median(length) AS median_ortholog_length, {_select_stats(_ORTHO_STATS)}
  FROM orthologs WHERE passes_raw_cds_qc AND seq_ok AND status = 'Single' GROUP BY genome_pk""".replace("seq_ok", "length IS NOT NULL"),
)
def ortholog_summary(spark, d, models=I.models):
    return rounded(FT.ortholog_summary(orthologs(spark, d, models)))


_FEATURE_STATS = _select_stats(_stats_sql("gc", "gc", "length"))


@query(
    "a07_intron_summary",
    f"""WITH {I.SEQS_SQL}, {I.MODELS_SQL}, {I.GENOMES_SQL}, {INTRONS_SQL}, {INTRON_SEQ},
  rows AS (SELECT genome_pk, gene, length, {gc_sql('seq')} AS gc FROM intron_seq WHERE status = 'Single')
  SELECT g.genome_pk, coalesce(n_introns, 0) AS n_introns, coalesce(n_orthologs, 0) AS n_orthologs,
    coalesce(callable_bp_total, 0) AS callable_bp_total, s.* EXCLUDE (genome_pk, n_introns, n_orthologs, callable_bp_total),
    CASE WHEN n_introns IS NULL THEN 'not_recoverable_from_compleasm' ELSE 'recovered' END AS recovery_status
  FROM genomes g LEFT JOIN (SELECT genome_pk, count(*) AS n_introns, count(DISTINCT gene) AS n_orthologs,
    sum(length)::BIGINT AS callable_bp_total, round(avg(length), 6) AS mean_intron_length,
    median(length) AS median_intron_length, {_FEATURE_STATS} FROM rows GROUP BY genome_pk) s ON s.genome_pk = g.genome_pk""",
)
def intron_summary(spark, d, models=I.models):
    introns = IV.infer_introns(models(spark, d).where("status = 'Single'"))
    counted = stored(IV.intron_counts(introns, I.chunk_store(spark, d, C), C))
    return rounded(FT.intron_summary(counted, I.genomes(spark, d)))


@query(
    "a08_flank_summary",
    f"""WITH {I.SEQS_SQL}, {I.MODELS_SQL}, {I.GENOMES_SQL}, {FLANKS_SQL}
  SELECT g.genome_pk, k AS flank_set_pk, coalesce(n_flanks, 0) AS n_flanks, coalesce(n_orthologs, 0) AS n_orthologs,
    coalesce(callable_bp_total, 0) AS callable_bp_total, s.* EXCLUDE (genome_pk, flank_set_pk, n_flanks, n_orthologs, callable_bp_total),
    CASE WHEN n_flanks IS NULL THEN 'not_recoverable_from_compleasm' ELSE 'recovered' END AS recovery_status
  FROM (SELECT genome_pk, unnest([1, 2, 3])::BIGINT AS k FROM genomes) g LEFT JOIN (SELECT genome_pk, flank_set_pk, count(*) AS n_flanks,
    count(DISTINCT gene) AS n_orthologs, sum(length)::BIGINT AS callable_bp_total, round(avg(length), 6) AS mean_flank_length,
    median(length) AS median_flank_length, round(avg(upstream_gc), 6) AS mean_upstream_gc,
    round(avg(downstream_gc), 6) AS mean_downstream_gc, {_FEATURE_STATS}
    FROM flanks WHERE status = 'Single' GROUP BY genome_pk, flank_set_pk) s ON s.genome_pk = g.genome_pk AND s.flank_set_pk = k""",
)
def flank_summary(spark, d, models=I.models):
    flanks = stored(IV.extract_flanks(models(spark, d).where("status = 'Single'"), I.chunk_store(spark, d, C), C))
    return rounded(FT.flank_summary(flanks, I.genomes(spark, d)))


# The same operators on exons that lie over the whole sequence: introns and genes cross many chunks, some reach beyond the end.
for _name, _near, _function in (
    ("j09_slice_far", "j09_slice_intervals", slice_intervals),
    ("j10_cds_far", "j10_extract_cds", extract_cds),
    ("j11_introns_far", "j11_extract_introns", extract_introns),
    ("j12_flanks_far", "j12_extract_flanks", extract_flanks),
    ("j13_validate_far", "j13_validate_introns", validate_introns),
    ("j13_summary_far", "j13_validation_summary", validation_summary),
    ("w05_introns_far", "w05_infer_introns", infer_introns),
    ("j03_orthologs_far", "j03_assemble_orthologs", assemble_orthologs),
    ("a06_orthologs_far", "a06_ortholog_summary", ortholog_summary),
    ("a07_introns_far", "a07_intron_summary", intron_summary),
    ("a08_flanks_far", "a08_flank_summary", flank_summary),
):
    _sql = ORACLES[_near].replace(I.EXONS_SQL, I.FAR_EXONS_SQL)
    _sql = _sql if I.DNA_SQL in _sql else _sql.replace("WITH ", f"WITH {I.DNA_SQL}, ", 1)
    query(_name, _sql)(partial(_function, models=I.far_models))


@query(
    "j23_compare_cds",
    f"""WITH {I.CDS_SQL}, ours AS (SELECT gene, seq FROM cds WHERE piece % 3 <> 1 UNION ALL SELECT 'h_' || gene, seq FROM cds WHERE piece % 6 = 1),
  theirs AS (SELECT gene, 'h_' || gene AS header, CASE piece % 4 WHEN 0 THEN replace(seq, 'A', 'C') WHEN 1 THEN left(seq, 20) ELSE seq END AS seq FROM cds),
  j AS (SELECT t.*, coalesce(a.seq, b.seq) AS o FROM theirs t LEFT JOIN ours a ON a.gene = t.gene LEFT JOIN ours b ON b.gene = t.header)
  SELECT gene, header, o IS NOT NULL AS found, o = seq AS exact_match, length(seq) AS len_theirs, length(o) AS len_ours,
    CASE WHEN length(o) = length(seq) THEN hamming(seq, o) END AS mismatches_same_len,
    CASE WHEN length(o) = length(seq) THEN round(1 - hamming(seq, o) / CAST(length(seq) AS DOUBLE), 6) END AS identity_same_len FROM j""",
)
def compare_cds(spark, d):
    cds, p = I.cds(spark, d), F.col("piece")
    header = F.concat(F.lit("h_"), "gene")
    ours = cds.where(p % 3 != 1).select("gene", "seq").unionByName(cds.where(p % 6 == 1).select(header.alias("gene"), "seq"))
    text = (
        F.when(p % 4 == 0, F.replace("seq", F.lit("A"), F.lit("C"))).when(p % 4 == 1, F.left("seq", F.lit(20))).otherwise(F.col("seq"))
    )
    return rounded(FT.compare_cds(ours, cds.select("gene", header.alias("header"), text.alias("seq"))))


FULL_SQL = """full_table AS (SELECT 'GCA_' || (l_suppkey % 40) AS accession, 'g' || l_partkey AS gene,
  CASE WHEN l_quantity < 20 THEN 'Single' WHEN l_quantity < 30 THEN 'Complete' WHEN l_quantity < 40 THEN 'Duplicated'
    WHEN l_quantity < 45 THEN 'Fragmented' ELSE 'Missing' END AS status FROM lineitem)"""


def full_table(spark, d):
    q = F.col("l_quantity")
    status = (
        F.when(q < 20, "Single").when(q < 30, "Complete").when(q < 40, "Duplicated").when(q < 45, "Fragmented").otherwise("Missing")
    )
    return I.table(spark, d, "lineitem").select(
        F.concat(F.lit("GCA_"), F.col("l_suppkey") % 40).alias("accession"),
        F.concat(F.lit("g"), "l_partkey").alias("gene"),
        status.alias("status"),
    )


_LETTERS = {"s": "Single", "d": "Duplicated", "f": "Fragmented", "i": "Interspaced", "m": "Missing"}
_COUNT = {x: f"count(DISTINCT gene) FILTER (st = '{s}')" for x, s in _LETTERS.items()}


@query(
    "a31_completeness",
    f"""WITH {FULL_SQL} SELECT accession, {", ".join(f"{e} AS {x}" for x, e in _COUNT.items())}, count(DISTINCT gene) AS n,
  {", ".join(f"round({e} * 100.0::DOUBLE / count(DISTINCT gene), 6) AS {x}_pct" for x, e in _COUNT.items())}
  FROM (SELECT *, replace(status, 'Complete', 'Single') AS st FROM full_table) GROUP BY accession""",
)
def completeness(spark, d):
    return rounded(FT.completeness(full_table(spark, d)))


@query(
    "w09_assign_pk",
    f"""WITH {I.MODELS_SQL}, {INTRONS_SQL} SELECT gene, intron_no, row_number() OVER (ORDER BY genome_pk, gene, intron_no) + 99 AS intron_pk FROM introns""",
)
def assign_keys(spark, d):
    introns = IV.infer_introns(I.models(spark, d)).select("genome_pk", "gene", "intron_no")
    return assign_pk(introns, ["genome_pk", "gene", "intron_no"], "intron_pk", start=100).drop("genome_pk")
