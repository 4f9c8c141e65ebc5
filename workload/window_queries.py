"""Window tiling and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from baseloom.operators import windows as W
from baseloom.session import stored
from workload import inputs as I
from workload.registry import query, rounded

_COUNTS = """genome_pk, sequence_pk, size, step, s0, len AS seq_len, p,
  length(p) AS w, length(p)-length(replace(p,'A','')) AS a, length(p)-length(replace(p,'C','')) AS c,
  length(p)-length(replace(p,'G','')) AS g, length(p)-length(replace(p,'T','')) AS t,
  length(p)-length(replace(p,'N','')) AS n"""


def windows_sql(pairs: list[tuple[int, int]], where: str = "true") -> str:
    values = ", ".join(f"({s}, {t})" for s, t in pairs)
    return f"""{I.SEQS_SQL}, win AS (SELECT genome_pk, sequence_pk, size AS standard_window_size_bp,
  step AS step_size_bp, s0 // step + 1 AS window_rank, s0 + 1 AS start_bp, s0 + w AS end_bp,
  (s0 + 1 + s0 + w) // 2 AS mid_bp, w AS width_actual_bp, a AS a_count, c AS c_count, g AS g_count, t AS t_count,
  n AS n_count, w - a - c - g - t - n AS other_count, a + c + g + t AS callable_bp, g + c AS gc_bp,
  CAST(g + c AS DOUBLE) / nullif(a + c + g + t, 0) AS gc_prop, CAST(a + c + g + t AS DOUBLE) / w AS callable_frac,
  n AS masked_bp, 0 AS gap_bp, (w = size AND CAST(a + c + g + t AS DOUBLE) / w >= 0.8) AS keep_flag
  FROM (SELECT {_COUNTS} FROM (SELECT *, substring(bases, CAST(s0 AS BIGINT) + 1, size) AS p FROM (
    SELECT genome_pk, sequence_pk, size, step, sequence_length AS len, bases,
      unnest(range(0, sequence_length, step)) AS s0
    FROM seqs, (VALUES {values}) AS sizes(size, step) WHERE {where}))))"""


WINDOW_COLUMNS = [
    "genome_pk", "sequence_pk", "standard_window_size_bp", "step_size_bp", "window_rank", "start_bp", "end_bp",
    "mid_bp", "width_actual_bp", "a_count", "c_count", "g_count", "t_count", "n_count", "other_count", "callable_bp",
    "gc_bp", "gc_prop", "callable_frac", "masked_bp", "gap_bp", "keep_flag",
]


def _select(columns, doubles):
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in columns)


TUMBLING = [(600, 600), (300, 300)]
_WIN = _select(WINDOW_COLUMNS, {"gc_prop", "callable_frac"})
_INTS = {"window_rank", "start_bp", "end_bp", "mid_bp", "width_actual_bp"}


def tumbling(spark, d):
    return W.tile_windows(I.chunks(spark, d), I.SIZES, chunk_bp=I.CHUNK_BP)


@query("w01_tile_windows", f"WITH {windows_sql(TUMBLING)} SELECT {_WIN} FROM win")
def tile_windows(spark, d):
    return rounded(tumbling(spark, d).select(*WINDOW_COLUMNS))


@query("w01_sliding_windows", f"WITH {windows_sql([(500, 200)])} SELECT {_WIN} FROM win")
def sliding_windows(spark, d):
    return rounded(W.tile_windows(I.chunks(spark, d), [500], [200], chunk_bp=I.CHUNK_BP).select(*WINDOW_COLUMNS))


_Q = """avg(gc_prop) AS mean_gc, sum(gc_prop * callable_bp) / sum(callable_bp) AS weighted_mean_gc,
  CASE WHEN count(*) > 1 THEN stddev_samp(gc_prop) ELSE 0.0 END AS sd_gc,
  CASE WHEN count(*) > 1 THEN var_samp(gc_prop) ELSE 0.0 END AS var_gc, median(gc_prop) AS median_gc,
  mad(gc_prop) AS mad_gc,
  quantile_cont(gc_prop, 0.75::DOUBLE) - quantile_cont(gc_prop, 0.25::DOUBLE) AS iqr_gc,
  quantile_cont(gc_prop, 0.05::DOUBLE) AS q05_gc, quantile_cont(gc_prop, 0.25::DOUBLE) AS q25_gc,
  quantile_cont(gc_prop, 0.75::DOUBLE) AS q75_gc, quantile_cont(gc_prop, 0.95::DOUBLE) AS q95_gc,
  avg(callable_frac) AS mean_callable_fraction, median(callable_frac) AS median_callable_fraction,
  sum(callable_bp) AS callable_bp_total, sum(gap_bp) AS gap_bp_total"""
_STATS = [
    "mean_gc", "weighted_mean_gc", "sd_gc", "var_gc", "median_gc", "mad_gc", "iqr_gc", "q05_gc", "q25_gc", "q75_gc",
    "q95_gc", "mean_callable_fraction",
]


def _summary_sql(keys: str, extra: str) -> str:
    stats = ", ".join(f"round({c}, 6) AS {c}" for c in _STATS + (["median_callable_fraction"] if extra else []))
    return f"""summary AS (SELECT {keys}, standard_window_size_bp, step_size_bp, n_windows_total, n_windows_kept, {extra}
  coalesce(callable_bp_total, 0)::BIGINT AS callable_bp_total, coalesce(gap_bp_total, 0)::BIGINT AS gap_bp_total, {stats}
  FROM (SELECT {keys}, standard_window_size_bp, step_size_bp, count(*) AS n_windows_total,
    count(*) FILTER (keep_flag) AS n_windows_kept,
    count(*) FILTER (NOT keep_flag AND width_actual_bp = standard_window_size_bp) AS n_windows_excluded_missing,
    count(*) FILTER (width_actual_bp < standard_window_size_bp) AS n_windows_excluded_short
    FROM win GROUP BY ALL) a
  LEFT JOIN (SELECT {keys}, standard_window_size_bp, step_size_bp, {_Q} FROM win WHERE keep_flag GROUP BY {keys},
    standard_window_size_bp, step_size_bp) b
  USING ({keys}, standard_window_size_bp, step_size_bp))"""


_SEQ_SUMMARY = _summary_sql("genome_pk, sequence_pk", "n_windows_excluded_missing, n_windows_excluded_short,")


@query("a01_sequence_summary", f"WITH {windows_sql(TUMBLING)}, {_SEQ_SUMMARY} SELECT * FROM summary")
def sequence_summary(spark, d):
    return rounded(W.sequence_summary(stored(tumbling(spark, d))))


_GENOME = f"""WITH {windows_sql(TUMBLING)}, {I.GENOMES_SQL}, {_summary_sql("genome_pk", "")}
SELECT g.genome_pk, sizes.size AS standard_window_size_bp, sizes.step AS step_size_bp,
  coalesce(n_windows_total, 0) AS n_windows_total, coalesce(n_windows_kept, 0) AS n_windows_kept,
  coalesce(callable_bp_total, 0) AS callable_bp_total, coalesce(gap_bp_total, 0) AS gap_bp_total,
  {", ".join(_STATS)}, coalesce(seq_count_used, 0) AS seq_count_used, round(largest_seq_fraction, 6) AS largest_seq_fraction
FROM genomes g CROSS JOIN (VALUES (600, 600), (300, 300)) AS sizes(size, step)
LEFT JOIN summary s ON s.genome_pk = g.genome_pk AND s.standard_window_size_bp = size AND s.step_size_bp = step
LEFT JOIN (SELECT genome_pk, count(*) AS seq_count_used,
  CAST(max(sequence_length) AS DOUBLE) / sum(sequence_length) AS largest_seq_fraction FROM seqs GROUP BY genome_pk) u
  ON u.genome_pk = g.genome_pk"""


@query("a02_genome_summary", _GENOME)
def genome_summary(spark, d):
    return rounded(
        W.genome_summary(stored(tumbling(spark, d)), I.seqs(spark, d), I.genomes(spark, d), W.pair_steps(I.SIZES, None))
    )


@query(
    "a03_sequence_gc",
    f"""WITH {windows_sql([(300, 300)])} SELECT sequence_pk, sum(gc_bp)::BIGINT AS gc_bp,
  sum(callable_bp)::BIGINT AS callable_bp, round(CAST(sum(gc_bp) AS DOUBLE) / nullif(sum(callable_bp), 0), 6) AS gc
  FROM win GROUP BY sequence_pk""",
)
def sequence_gc(spark, d):
    return rounded(W.sequence_gc(W.tile_windows(I.chunks(spark, d), [300], chunk_bp=I.CHUNK_BP)))


@query(
    "f07_filter_sequence_types",
    f"""WITH {I.SEQS_SQL} SELECT sequence_pk, sequence_type, 'chromosome_plus_scaffold' AS seq_scope FROM seqs
  WHERE sequence_type IN ('chromosome', 'scaffold')""",
)
def filter_types(spark, d):
    return W.filter_sequence_types(I.seqs(spark, d), ["scaffold", "chromosome"]).select(
        "sequence_pk", "sequence_type", "seq_scope"
    )


@query(
    "w02_window_sets",
    f"""WITH {I.SEQS_SQL}, {I.GENOMES_SQL} SELECT row_number() OVER (ORDER BY genome_pk, place) AS window_set_pk,
  CAST(1 AS BIGINT) AS run_pk, genome_pk, 'fixed' AS tiling_type, CAST(size AS BIGINT) AS standard_window_size_bp,
  CAST(size AS BIGINT) AS step_size_bp, CAST(0 AS BIGINT) AS start_offset_bp, 'chromosome_only' AS seq_scope
  FROM genomes, (VALUES (0, 600), (1, 300)) AS s(place, size)""",
)
def window_sets(spark, d):
    return W.window_sets(I.genomes(spark, d), I.SIZES, None, 1, ["chromosome"])


@query(
    "a04_sequence_type_audit",
    f"""WITH {I.SEQS_SQL}, {I.GENOMES_SQL}, counts AS (SELECT genome_pk, count(*) AS n,
    count(*) FILTER (sequence_type = 'chromosome') AS c, count(*) FILTER (sequence_type = 'scaffold') AS s,
    count(*) FILTER (sequence_type = 'mitochondrion') AS m FROM seqs GROUP BY genome_pk),
  stats AS (SELECT accession_id, CASE WHEN genome_pk % 3 = 0 THEN 0 ELSE c END AS tc,
    CASE WHEN genome_pk % 5 > 0 THEN n END AS tn FROM genomes JOIN counts USING (genome_pk))
  SELECT genome_pk, accession_id, coalesce(n, 0) AS n_fasta_sequences, coalesce(c, 0) AS n_chromosome_inferred,
    coalesce(s, 0) AS n_scaffold_inferred, coalesce(m, 0) AS n_mitochondrion_inferred,
    CAST(0 AS BIGINT) AS n_unclassified_inferred, tc AS ncbi_total_chromosomes, tn AS ncbi_component_sequences,
    coalesce(c, 0) = tc AS chromosome_count_match, coalesce(n, 0) = tn AS component_sequence_count_match,
    CASE WHEN coalesce(c, 0) = tc AND coalesce(n, 0) = tn THEN 'pass' WHEN tc IS NULL OR tn IS NULL
      THEN 'missing_ncbi_stats' ELSE 'review' END AS audit_status
  FROM genomes LEFT JOIN counts USING (genome_pk) LEFT JOIN stats USING (accession_id)""",
)
def type_audit(spark, d):
    seqs, genomes = I.seqs(spark, d), I.genomes(spark, d)
    stats = (
        seqs.groupBy("genome_pk")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sequence_type") == "chromosome").alias("c"))
        .join(genomes, "genome_pk")
        .select(
            "accession_id",
            F.when(F.col("genome_pk") % 3 == 0, 0).otherwise(F.col("c")).alias("ncbi_total_chromosomes"),
            F.when(F.col("genome_pk") % 5 > 0, F.col("n")).alias("ncbi_component_sequences"),
        )
    )
    return W.sequence_type_audit(seqs, genomes, stats)


def _any(patterns: list[str]) -> str:
    """The operator's fixed patterns, as they stand, as one alternation."""
    return "|".join(patterns)


_HEADERS = """heads AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'NC_' || doc_id WHEN 1 THEN 'JAAAAA' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.1'
  WHEN 2 THEN 'NW_' || doc_id ELSE 'seq' || doc_id END AS sequence_id,
  CASE doc_id % 7 WHEN 0 THEN 'mitochondrion, complete genome' WHEN 1 THEN 'chromosome ' || (doc_id % 30) || ', whole genome shotgun sequence'
  WHEN 2 THEN 'unplaced chromosome Un' WHEN 3 THEN 'linkage_group LG' || (doc_id % 9) WHEN 4 THEN 'whole genome shotgun sequence'
  WHEN 5 THEN 'chr|M' ELSE source END AS description FROM documents)"""


@query(
    "p10_classify_sequence",
    f"""WITH {_HEADERS}, t AS (SELECT *, regexp_replace(regexp_replace(lower(sequence_id || ' ' || description),
    '[|_\\-:;,\\[\\]()=]+', ' ', 'g'), '\\s+', ' ', 'g') AS x, upper(sequence_id) AS u FROM heads)
  SELECT doc_id, CASE
    WHEN regexp_matches(x, '{_any(W.MITOCHONDRIAL)}') THEN 'mitochondrion'
    WHEN regexp_matches(u, '{W.CHROMOSOME_PREFIX}') THEN 'chromosome' WHEN regexp_matches(u, '{W.SCAFFOLD_PREFIX}') THEN 'scaffold'
    WHEN regexp_matches(x, '{_any(W.EXPLICIT_SCAFFOLD)}') THEN 'scaffold'
    WHEN regexp_matches(x, '{_any(W.CHROMOSOMAL)}') THEN 'chromosome'
    WHEN regexp_matches(x, '{_any(W.SHOTGUN)}') THEN 'scaffold'
    WHEN regexp_matches(u, '{W.WGS_ACCESSION}') THEN 'scaffold' ELSE 'unclassified' END AS sequence_type FROM t""",
)
def classify(spark, d):
    k = F.col("doc_id")
    identifier = (
        F.when(k % 8 == 0, F.concat(F.lit("NC_"), k))
        .when(k % 8 == 1, F.concat(F.lit("JAAAAA"), F.lpad(k.cast("string"), 9, "0"), F.lit(".1")))
        .when(k % 8 == 2, F.concat(F.lit("NW_"), k))
        .otherwise(F.concat(F.lit("seq"), k))
    )
    text = (
        F.when(k % 7 == 0, "mitochondrion, complete genome")
        .when(k % 7 == 1, F.concat(F.lit("chromosome "), k % 30, F.lit(", whole genome shotgun sequence")))
        .when(k % 7 == 2, "unplaced chromosome Un")
        .when(k % 7 == 3, F.concat(F.lit("linkage_group LG"), k % 9))
        .when(k % 7 == 4, "whole genome shotgun sequence")
        .when(k % 7 == 5, "chr|M")
        .otherwise(F.col("source"))
    )
    return I.table(spark, d, "documents").select("doc_id", W.classify_sequence(identifier, text).alias("sequence_type"))
