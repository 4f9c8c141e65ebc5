"""Checks as rows, and twins whose results are small enough to compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from baseloom.operators import divergence as D
from baseloom.operators import validate as V
from workload import inputs as I
from workload.divergence_queries import BASE, DISP_SQL
from workload.feature_queries import compare_cds
from workload.registry import ORACLES, query, rounded

NAMES = ("customer", "orders", "part", "lineitem")
# Expected headers: one as it is, one in another order, one with a column too few and one too many, one of no table.
EXPECTED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_custkey", "o_orderkey", "o_orderdate"],
    "part": ["p_partkey", "p_name", "p_taxon"],
    "genomes": ["genome_pk"],
}
# Wanted columns: names in order of preference.
WANTED = {"key": ["Order Key", "l_orderkey", "ORDERKEY", "o orderkey", "CCustKey", "pPartkey"], "amount": ["total", "O_TotalPrice", "l_quantity"], "name": ["c name", "p_name", "C_NAME"]}


COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "lineitem": ["l_orderkey", "l_quantity"],
}
_FILLED = "filled AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, unnest([{', '.join(repr(c) for c in cs)}]) AS column_name, unnest([{', '.join(f'count({c})' for c in cs)}]) AS n_filled FROM {t}"
    for t, cs in COLUMNS.items()
) + ")"
_EXPECTED = "want(table_name, column_name, expected_at) AS (VALUES " + ", ".join(
    f"('{t}', '{c}', {i + 1})" for t, cs in EXPECTED.items() for i, c in enumerate(cs)
) + ")"
_REPORT = f"""{_FILLED}, {_EXPECTED}, have AS (SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS found_at FROM information_schema.columns
    WHERE table_name IN ('customer', 'orders', 'part')),
  report AS (SELECT table_name, column_name, expected_at, found_at, CASE WHEN table_name = 'genomes' THEN 'missing table' WHEN found_at IS NULL THEN 'missing'
    WHEN expected_at IS NULL THEN 'extra' WHEN found_at <> expected_at THEN 'other place' WHEN n_filled = 0 THEN 'empty' ELSE 'ok' END AS problem, n_filled
  FROM want FULL JOIN have USING (table_name, column_name) LEFT JOIN filled USING (table_name, column_name))"""


def _tables(spark, d, names=NAMES):
    return {t: I.table(spark, d, t) for t in names}


@query("v01_header_report", f"WITH {_REPORT} SELECT * FROM report")
def header_report(spark, d):
    return V.header_report(spark, _tables(spark, d), EXPECTED)


@query(
    "v07_missing_parts",
    f"""WITH {_REPORT} SELECT DISTINCT table_name, CASE WHEN problem = 'missing' THEN column_name END AS column_name, problem,
  CASE WHEN problem = 'missing' THEN table_name || ': column ' || column_name || ' is missing' ELSE 'no table ' || table_name END AS message FROM report WHERE problem LIKE 'missing%'""",
)
def missing_parts(spark, d):
    return V.missing_parts(spark, _tables(spark, d), EXPECTED)


_NAMES_SQL = ", ".join(f"('{w}', '{n}', {i})" for w, ns in WANTED.items() for i, n in enumerate(ns))


@query(
    "p07_column_report",
    f"""WITH {_FILLED}, names(wanted, name, place) AS (VALUES {_NAMES_SQL}), form AS (SELECT unnest([1, 2]) AS form),
  have AS (SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'part', 'lineitem')),
  hit AS (SELECT table_name, wanted, column_name, form, place FROM have, names, form
    WHERE CASE form WHEN 1 THEN lower(trim(name)) = lower(trim(column_name)) ELSE replace(replace(lower(name), ' ', ''), '_', '') = replace(replace(lower(column_name), ' ', ''), '_', '') END)
  SELECT t.table_name, t.wanted, h.column_name AS chosen, n_filled FROM (SELECT DISTINCT table_name, wanted FROM have, names) t
  LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY table_name, wanted ORDER BY form, place) = 1) h USING (table_name, wanted)
  LEFT JOIN filled f ON f.table_name = h.table_name AND f.column_name = h.column_name""",
)
def column_report(spark, d):
    return V.column_report(spark, _tables(spark, d), WANTED)


@query(
    "j14_displacements_by_edge",
    f"""WITH {BASE}, {DISP_SQL} SELECT child, parent, count(*) AS n_orthologs, round(sum(difference), 6) AS sum_difference, round(min(difference), 6) AS least,
  round(max(difference), 6) AS most, round(sum(squared_displacement), 6) AS sum_squared FROM disp GROUP BY child, parent""",
)
def displacements_by_edge(spark, d):
    rows = D.displacements(I.node_gc(spark, d), I.edges(spark, d))
    return rounded(
        rows.groupBy("child", "parent").agg(
            F.count(F.lit(1)).alias("n_orthologs"),
            F.sum("difference").alias("sum_difference"),
            F.min("difference").alias("least"),
            F.max("difference").alias("most"),
            F.sum("squared_displacement").alias("sum_squared"),
        )
    )


@query(
    "j23_compared_by_document",
    f"""SELECT split_part(gene, '_', 2) AS doc, count(*) AS n, count(*) FILTER (found) AS n_found, count(*) FILTER (exact_match) AS n_exact, sum(len_theirs)::BIGINT AS theirs,
  sum(len_ours)::BIGINT AS ours, sum(mismatches_same_len)::BIGINT AS mismatches, round(sum(identity_same_len), 4) AS identity FROM ({ORACLES["j23_compare_cds"]}) GROUP BY doc""",
)
def compared_by_document(spark, d):
    rows = compare_cds(spark, d)
    out = rows.groupBy(F.split_part("gene", F.lit("_"), F.lit(2)).alias("doc")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("found").alias("n_found"),
        F.count_if("exact_match").alias("n_exact"),
        F.sum("len_theirs").alias("theirs"),
        F.sum("len_ours").alias("ours"),
        F.sum("mismatches_same_len").alias("mismatches"),
        F.sum("identity_same_len").alias("identity"),
    )
    return rounded(out, "identity", places=4)
