"""Divergence along the tree, master tables, tree operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from baseloom.functions.names import coerce_node
from baseloom.operators import divergence as D
from baseloom.operators import tree_labels as L
from baseloom.operators import trees as T
from baseloom.session import stored
from workload import inputs as I
from workload.registry import query, rounded

BASE = I.NODE_GC_SQL
DISP_SQL = """disp AS (SELECT c.ortholog, e.child, e.parent, c.gc AS child_gc, p.gc AS parent_gc, c.gc - p.gc AS difference,
  (c.gc - p.gc) * (c.gc - p.gc) AS squared_displacement FROM edges e JOIN node_gc c ON c.node = e.child
  JOIN node_gc p ON p.node = e.parent AND p.ortholog = c.ortholog)"""
DIJ_SQL = DISP_SQL + """, dij AS (SELECT e.child, e.parent, sqrt(sum(squared_displacement)) AS dij FROM edges e
  LEFT JOIN disp USING (child, parent) GROUP BY e.child, e.parent)"""
TIP = "(node NOT LIKE 'node\\_%' ESCAPE '\\' AND node <> 'ancestral')"
DIANC_SQL = f"""dianc AS (SELECT node AS genus_species, sqrt(sum((gc - root) * (gc - root))) AS dianc FROM node_gc
  JOIN (SELECT ortholog, gc AS root FROM node_gc WHERE node = 'ancestral') USING (ortholog) WHERE {TIP} GROUP BY node)"""
GC3_SQL = """gc3 AS (SELECT node AS node_or_species, avg(gc) AS mean_gc3, stddev_samp(gc) AS sd_gc3, count(*) AS n_orthologs
  FROM node_gc GROUP BY node)"""


@query(
    "j14_displacements",
    f"""WITH {BASE}, {DISP_SQL} SELECT ortholog, child, parent, round(child_gc, 6) AS child_gc, round(parent_gc, 6) AS parent_gc,
  round(difference, 6) AS difference, round(squared_displacement, 6) AS squared_displacement FROM disp""",
)
def displacements(spark, d):
    return rounded(D.displacements(I.node_gc(spark, d), I.edges(spark, d)))


@query(
    "j15_missing_pairs",
    f"""WITH {BASE}, o AS (SELECT DISTINCT ortholog FROM node_gc)
  SELECT ortholog, child, CASE WHEN (ortholog, child) NOT IN (SELECT (ortholog, node) FROM node_gc) THEN 'CHILD_MISSING'
    ELSE 'PARENT_MISSING:' || parent END AS reason FROM o CROSS JOIN edges
  WHERE (ortholog, child) NOT IN (SELECT (ortholog, node) FROM node_gc) OR (ortholog, parent) NOT IN (SELECT (ortholog, node) FROM node_gc)""",
)
def missing_pairs(spark, d):
    return D.missing_pairs(stored(I.node_gc(spark, d).select("ortholog", "node")), I.edges(spark, d))


@query(
    "j15_missing_counts",
    f"""WITH {BASE}, o AS (SELECT count(DISTINCT ortholog) AS n FROM node_gc),
  c AS (SELECT e.child, e.parent, count(DISTINCT a.ortholog) AS has_child, count(DISTINCT CASE WHEN b.ortholog IS NOT NULL THEN a.ortholog END) AS has_both
    FROM edges e LEFT JOIN node_gc a ON a.node = e.child LEFT JOIN node_gc b ON b.node = e.parent AND b.ortholog = a.ortholog GROUP BY e.child, e.parent)
  SELECT child, parent, n - has_child AS n_child_missing, has_child - has_both AS n_parent_missing FROM c, o""",
)
def missing_counts(spark, d):
    return D.missing_counts(stored(I.node_gc(spark, d)), I.edges(spark, d))


@query("a14_dij", f"WITH {BASE}, {DIJ_SQL} SELECT child, parent, round(dij, 6) AS dij FROM dij")
def dij(spark, d):
    return rounded(D.dij(I.node_gc(spark, d), I.edges(spark, d)))


@query("a15_dianc", f"WITH {BASE}, {DIANC_SQL} SELECT genus_species, round(dianc, 6) AS dianc FROM dianc")
def dianc(spark, d):
    return rounded(D.dianc(I.node_gc(spark, d)))


@query(
    "a13_gc3_summary",
    f"WITH {BASE}, {GC3_SQL} SELECT node_or_species, round(mean_gc3, 6) AS mean_gc3, round(sd_gc3, 6) AS sd_gc3, n_orthologs FROM gc3",
)
def gc3(spark, d):
    return rounded(D.gc3_summary(I.node_gc(spark, d)))


@query(
    "w11_displacement_examples",
    f"""WITH {BASE}, {DISP_SQL}, f AS (SELECT *, TRY_CAST(nullif(regexp_extract(child, '^node_(\\d+)', 1), '') AS BIGINT) AS k
    FROM disp ORDER BY ortholog, child, parent LIMIT 200)
  SELECT ortholog, child, parent, round(squared_displacement, 6) AS squared_displacement FROM (
    (SELECT * FROM f WHERE k = (SELECT max(k) FROM f) ORDER BY ortholog, child, parent LIMIT 3) UNION
    (SELECT * FROM f WHERE child LIKE 'genus3\\_%' ESCAPE '\\' ORDER BY ortholog, child, parent LIMIT 3))""",
)
def examples(spark, d):
    disp = stored(D.displacements(I.node_gc(spark, d), I.edges(spark, d)).orderBy("ortholog", "child", "parent").limit(200))
    out = D.displacement_examples(disp, ["ortholog", "child", "parent"], "genus3")
    return rounded(out.select("ortholog", "child", "parent", "squared_displacement"))


def metadata_sources(spark, d):
    k = F.col("s_suppkey")
    supplier = I.table(spark, d, "supplier")
    first = supplier.where(k % 3 != 1).select(
        F.concat(F.lit("Genus"), k % 9, F.lit(" Sp"), k).alias("organism_name"),
        F.when(k % 4 == 0, "nan").when(k % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("GCA_"), k, F.lit(".1"))).alias("accession"),
        F.concat(F.lit("genus"), k % 9, F.lit("_sp"), k, F.lit("_sub")).alias("species_label"),
        k.alias("row_idx"),
    )
    second = supplier.where(k % 5 != 2).select(
        F.concat(F.lit("G. sp"), k).alias("organism_name"),
        F.concat(F.lit("GCF_"), k, F.lit(".2")).alias("accession"),
        F.concat(F.lit(" Genus"), k % 9, F.lit(" Sp"), k).alias("species_label"),
        k.alias("row_idx"),
    )
    return first, second


META_SQL = """meta AS (SELECT genus_species, organism_name, accession, genus_species AS manifest_merge_key FROM (
  SELECT 'genus' || (s_suppkey % 9) || '_sp' || s_suppkey AS genus_species, 'Genus' || (s_suppkey % 9) || ' Sp' || s_suppkey AS organism_name,
    CASE s_suppkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN NULL ELSE 'GCA_' || s_suppkey || '.1' END AS accession, 0 AS src FROM supplier WHERE s_suppkey % 3 <> 1
  UNION ALL SELECT 'genus' || (s_suppkey % 9) || '_sp' || s_suppkey, 'G. sp' || s_suppkey, 'GCF_' || s_suppkey || '.2', 1 FROM supplier WHERE s_suppkey % 5 <> 2)
  QUALIFY row_number() OVER (PARTITION BY genus_species ORDER BY coalesce(accession = 'nan', true), src) = 1)"""


@query("n06_species_metadata", f"WITH {META_SQL} SELECT * FROM meta")
def species_metadata(spark, d):
    return D.species_metadata(*metadata_sources(spark, d))


def gc4_input(spark, d):
    k = F.col("l_suppkey")
    return (
        I.table(spark, d, "lineitem")
        .where(k % 6 != 0)
        .groupBy(F.concat(F.lit("genus"), k % 9, F.lit("_sp"), k).alias("genus_species"))
        .agg(F.avg("l_tax").alias("mean_gc4"), F.stddev_samp("l_tax").alias("sd_gc4"), F.countDistinct(F.when(F.col("l_quantity") > 1, F.col("l_partkey"))).alias("n_gc4_values"))
    )


GC4_SQL = """gc4 AS (SELECT 'genus' || (l_suppkey % 9) || '_sp' || l_suppkey AS genus_species, avg(l_tax) AS mean_gc4,
  stddev_samp(l_tax) AS sd_gc4, count(DISTINCT CASE WHEN l_quantity > 1 THEN l_partkey END) AS n_gc4_values FROM lineitem WHERE l_suppkey % 6 <> 0 GROUP BY l_suppkey)"""
MASTER_SQL = f"""{BASE}, {GC3_SQL}, {DIANC_SQL}, {GC4_SQL}, {META_SQL}, tipgc AS (SELECT node_or_species AS genus_species, mean_gc3, sd_gc3, n_orthologs
    FROM gc3 WHERE {TIP.replace('node ', 'node_or_species ')}),
  master AS (SELECT genus_species, nullif(accession, 'nan') AS accession, mean_gc3, sd_gc3, n_orthologs, mean_gc4, sd_gc4, dianc, manifest_merge_key
    FROM tipgc LEFT JOIN dianc USING (genus_species) LEFT JOIN gc4 USING (genus_species) LEFT JOIN meta USING (genus_species)),
  master_all AS (SELECT genus_species, nullif(accession, 'nan') AS accession, mean_gc3, sd_gc3, n_orthologs, mean_gc4, sd_gc4, dianc, manifest_merge_key
    FROM meta LEFT JOIN tipgc USING (genus_species) LEFT JOIN dianc USING (genus_species) LEFT JOIN gc4 USING (genus_species))"""
_DOUBLES = "round(mean_gc3, 6) AS mean_gc3, round(sd_gc3, 6) AS sd_gc3, round(mean_gc4, 6) AS mean_gc4, round(sd_gc4, 6) AS sd_gc4, round(dianc, 6) AS dianc"


def master(spark, d, all_species=False, gc=None):
    gc = stored(I.node_gc(spark, d)) if gc is None else gc
    return D.master_table(
        D.gc3_summary(gc), D.dianc(gc), gc4_input(spark, d), D.species_metadata(*metadata_sources(spark, d)), all_species
    )


@query("j19_master_table", f"WITH {MASTER_SQL} SELECT * REPLACE ({_DOUBLES}) FROM master")
def master_table(spark, d):
    return rounded(master(spark, d))


@query("j19_master_all_species", f"WITH {MASTER_SQL} SELECT * REPLACE ({_DOUBLES}) FROM master_all WHERE mean_gc3 IS NOT NULL OR true")
def master_all(spark, d):
    return rounded(master(spark, d, True))


@query(
    "j19_count_mismatches",
    f"""WITH {BASE}, {GC3_SQL}, {GC4_SQL} SELECT genus_species, n_orthologs, n_gc4_values FROM gc3
  JOIN gc4 ON genus_species = node_or_species WHERE n_orthologs <> n_gc4_values""",
)
def mismatches(spark, d):
    return D.count_mismatches(D.gc3_summary(I.node_gc(spark, d)), gc4_input(spark, d))


def wide_inputs(spark, d):
    k = F.col("c_custkey")
    key = F.concat(F.lit("genus"), k % 9, F.lit("_sp"), k).alias("genus_species")
    customer = I.table(spark, d, "customer")
    part = I.table(spark, d, "part")
    p = F.col("p_partkey")
    pkey = F.concat(F.lit("genus"), (p % 150) % 9, F.lit("_sp"), p % 150).alias("genus_species")
    sizes = part.select(pkey, F.when(p % 4 != 0, F.col("p_size").cast("double")).alias("genome_size"), p.alias("row_idx"))
    mass = customer.select(key, F.when(k % 3 != 0, F.col("c_acctbal")).alias("mass_preferred"), F.lit("GCX").alias("accession"), k.alias("row_idx"))
    thermal = part.select(pkey, F.when(p % 5 == 0, F.col("p_retailprice")).alias("ctmax"), p.alias("row_idx"))
    return sizes, mass, thermal


WIDE_SQL = """pk AS (SELECT *, 'genus' || ((p_partkey % 150) % 9) || '_sp' || (p_partkey % 150) AS genus_species FROM part),
  sizes AS (SELECT genus_species, first(CAST(p_size AS DOUBLE) ORDER BY p_partkey) FILTER (p_partkey % 4 <> 0) AS genome_size FROM pk GROUP BY genus_species),
  mass AS (SELECT 'genus' || (c_custkey % 9) || '_sp' || c_custkey AS genus_species, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS mass_preferred FROM customer),
  thermal AS (SELECT genus_species, first(p_retailprice ORDER BY p_partkey) FILTER (p_partkey % 5 = 0) AS ctmax FROM pk GROUP BY genus_species)"""


@query(
    "j20_master_wide",
    f"""WITH {MASTER_SQL}, {WIDE_SQL} SELECT master.* REPLACE ({_DOUBLES}, CASE WHEN mass.genus_species IS NOT NULL THEN coalesce(accession, 'GCX') ELSE accession END AS accession),
  genome_size, mass_preferred, ctmax FROM master LEFT JOIN sizes USING (genus_species) LEFT JOIN mass USING (genus_species) LEFT JOIN thermal USING (genus_species)""",
)
def master_wide(spark, d):
    return rounded(D.master_table_wide(master(spark, d), *wide_inputs(spark, d)))


@query(
    "a25_merge_diagnostics",
    f"""WITH {MASTER_SQL} SELECT 'rows_in_output' AS diagnostic, count(*) AS value FROM master UNION ALL SELECT 'rows_with_accession', count(accession) FROM master
  UNION ALL SELECT 'rows_with_mean_gc4', count(mean_gc4) FROM master UNION ALL SELECT 'rows_with_dianc', count(dianc) FROM master
  UNION ALL SELECT 'species_with_gc3_results', count(*) FROM tipgc UNION ALL SELECT 'species_in_metadata', count(*) FROM meta
  UNION ALL SELECT 'gc_species_missing_from_metadata', count(*) FROM tipgc WHERE genus_species NOT IN (SELECT genus_species FROM meta)
  UNION ALL SELECT 'metadata_species_missing_gc_results', count(*) FROM meta WHERE genus_species NOT IN (SELECT genus_species FROM tipgc)""",
)
def diagnostics(spark, d):
    gc = stored(I.node_gc(spark, d))
    meta = D.species_metadata(*metadata_sources(spark, d))
    return D.merge_diagnostics(stored(master(spark, d, gc=gc)), D.gc3_summary(gc), meta, ["accession", "mean_gc4", "dianc"])


@query(
    "a26_merge_report",
    f"""WITH {MASTER_SQL}, {WIDE_SQL} SELECT genus_species, s.genus_species IS NOT NULL AS present_in_sizes, coalesce(s.genome_size IS NOT NULL, false) AS has_sizes_value,
  m.genus_species IS NOT NULL AS present_in_mass, m.mass_preferred IS NOT NULL AS has_mass_value,
  t.genus_species IS NOT NULL AS present_in_thermal, t.ctmax IS NOT NULL AS has_thermal_value FROM master
  LEFT JOIN sizes s USING (genus_species) LEFT JOIN mass m USING (genus_species) LEFT JOIN thermal t USING (genus_species)""",
)
def report(spark, d):
    sizes, mass, thermal = wide_inputs(spark, d)
    inputs = {"sizes": (sizes, "genome_size"), "mass": (mass, "mass_preferred"), "thermal": (thermal, "ctmax")}
    return D.merge_report(master(spark, d), inputs)


def plot_inputs(spark, d):
    gc = stored(I.node_gc(spark, d))
    edges = I.edges(spark, d)
    dist = D.dij(gc, edges).where(F.col("child") != "node_203").withColumn("row_idx", F.lit(0))
    doubled = dist.unionByName(dist.where(F.col("child").startswith("node_10")).withColumn("dij", F.lit(1e9)).withColumn("row_idx", F.lit(1)))
    means = D.gc3_summary(gc).select(F.col("node_or_species").alias("node"), F.col("mean_gc3").alias("gc"))
    return edges, stored(doubled), stored(means.where(F.col("node") != "node_204"))


PLOT_SQL = f"""{BASE}, {GC3_SQL}, {DIJ_SQL}, d1 AS (SELECT child, dij FROM dij WHERE child <> 'node_203'),
  means AS (SELECT node_or_species AS node, mean_gc3 AS gc FROM gc3 WHERE node_or_species <> 'node_204')"""


@query(
    "j21_edge_plot_table",
    f"""WITH {PLOT_SQL} SELECT e.child, e.parent, round(coalesce(dij, 0.05::DOUBLE * (SELECT coalesce(min(dij), 1) FROM d1)), 6) AS dij_branch_length,
  round(p.gc, 6) AS parent_gc3, round(c.gc, 6) AS child_gc3, dij IS NULL AS filled FROM edges e LEFT JOIN d1 USING (child)
  LEFT JOIN means c ON c.node = e.child LEFT JOIN means p ON p.node = e.parent""",
)
def edge_plot(spark, d):
    return rounded(D.edge_plot_table(*plot_inputs(spark, d)))


@query(
    "a35_match_diagnostics",
    f"""WITH {PLOT_SQL} SELECT 'child_dij' AS "check", count(dij) AS matched, count(*) AS total FROM edges LEFT JOIN d1 USING (child)
  UNION ALL SELECT 'child_gc', count(gc), count(*) FROM edges LEFT JOIN means ON node = child
  UNION ALL SELECT 'parent_gc', count(gc), count(*) FROM edges LEFT JOIN means ON node = parent
  UNION ALL SELECT 'duplicate_dij_child', count(*) FILTER (child LIKE 'node\\_10%' ESCAPE '\\'), count(*) FROM d1""",
)
def match_diagnostics(spark, d):
    return D.match_diagnostics(*plot_inputs(spark, d))


@query(
    "a35_unmatched_ends",
    f"""WITH {PLOT_SQL} SELECT DISTINCT 'child_dij' AS "check", child AS node FROM edges WHERE child NOT IN (SELECT child FROM d1 WHERE dij IS NOT NULL)
  UNION SELECT 'child_gc', child FROM edges WHERE child NOT IN (SELECT node FROM means)
  UNION SELECT 'parent_gc', parent FROM edges WHERE parent NOT IN (SELECT node FROM means)""",
)
def unmatched_ends(spark, d):
    return D.unmatched_ends(*plot_inputs(spark, d))


@query(
    "g03_ancestral_gc",
    """WITH lk AS (SELECT l_partkey, avg(l_discount) * 100 AS gc FROM lineitem GROUP BY l_partkey)
  SELECT round(avg(gc), 6) AS mean_gc, round(min(gc), 6) AS min_gc, round(max(gc), 6) AS max_gc, count(gc) AS n_files, round(avg(gc), 6) AS ancestral_gc FROM lk""",
)
def ancestral(spark, d):
    files = I.table(spark, d, "lineitem").groupBy("l_partkey").agg((F.avg("l_discount") * 100).alias("gc"))
    return rounded(D.ancestral_gc(files, D.gc3_summary(I.node_gc(spark, d))))


_CLOSURE = f"""{I.EDGES_SQL}, anc AS (SELECT child AS node, parent AS ancestor, CAST(1 AS BIGINT) AS distance FROM edges
  UNION ALL SELECT a.node, e.parent, a.distance + 1 FROM anc a JOIN edges e ON e.child = a.ancestor)"""


@query("g01_descendants", f"WITH RECURSIVE {_CLOSURE} SELECT * FROM anc")
def descendants(spark, d):
    return T.ancestor_pairs(I.edges(spark, d))


@query(
    "g01_descendant_tips",
    f"""WITH RECURSIVE {_CLOSURE} SELECT ancestor AS node, count(*) AS n_tips FROM anc WHERE {TIP} GROUP BY ancestor""",
)
def descendant_tips(spark, d):
    return L.tip_signatures(L.interval_labels(I.edges(spark, d))).select("node", "n_tips")


@query(
    "j22_match_nodes",
    f"""WITH RECURSIVE {_CLOSURE}, sig AS (SELECT ancestor AS node, string_agg(node, '|' ORDER BY node) AS s, count(*) AS n_tips
    FROM anc WHERE {TIP} GROUP BY ancestor)
  SELECT a.node AS node_a, a.n_tips, CASE WHEN b.node = 'ancestral' THEN 'ancestral' ELSE 'node_' || (CAST(b.node[6:] AS BIGINT) + 1000) END AS node_b
  FROM sig a LEFT JOIN sig b USING (s)""",
)
def match_nodes(spark, d):
    edges = I.edges(spark, d)

    def renumbered(name):
        inner = F.regexp_extract(name, r"^node_(\d+)$", 1).try_cast("bigint")
        return F.coalesce(F.concat(F.lit("node_"), inner + 1000), F.col(name)).alias(name)

    return T.match_nodes(edges, edges.select(renumbered("child"), renumbered("parent")))


@query("g01_tip_pairs", f"WITH RECURSIVE {_CLOSURE} SELECT ancestor AS node, node AS tip FROM anc WHERE {TIP}")
def tip_pairs(spark, d):
    return T.descendant_tips(I.edges(spark, d))


@query(
    "g01_subtree_sizes",
    f"""WITH RECURSIVE {_CLOSURE} SELECT n.node, count(anc.node) AS n_below FROM (SELECT child AS node FROM edges UNION SELECT parent FROM edges) n
  LEFT JOIN anc ON anc.ancestor = n.node GROUP BY n.node""",
)
def subtree_sizes(spark, d):
    return L.interval_labels(I.edges(spark, d)).select("node", F.expr("(leave - enter - 1) DIV 2").alias("n_below"))


def comb(spark, d, shift=0):
    """A tree as deep as there are customers: each inner node has one tip and the next inner node. ``shift`` renumbers nodes and swaps neighbouring tips."""
    k = F.col("k")
    rows = I.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    tip = F.when(F.lit(shift == 0), k).when(k % 2 == 0, k + 1).otherwise(k - 1)
    spine = rows.where("k > 0").select(F.concat(F.lit("node_"), F.col("k") + shift).alias("child"), F.concat(F.lit("node_"), F.col("k") - 1 + shift).alias("parent"))
    tips = rows.select(F.concat(F.lit("genus_sp"), tip).alias("child"), F.concat(F.lit("node_"), F.col("k") + shift).alias("parent"))
    return spine.unionByName(tips)


@query("g01_comb_tips", "SELECT 'node_' || c_custkey AS node, (SELECT count(*) FROM customer) - c_custkey AS n_tips FROM customer")
def comb_tips(spark, d):
    return L.tip_signatures(L.interval_labels(comb(spark, d))).select("node", "n_tips")


@query(
    "j22_match_comb",
    """SELECT 'node_' || c_custkey AS node_a, (SELECT count(*) FROM customer) - c_custkey AS n_tips,
  CASE WHEN c_custkey % 2 = 0 THEN 'node_' || (c_custkey + 5000) END AS node_b FROM customer""",
)
def match_comb(spark, d):
    return T.match_nodes(comb(spark, d), comb(spark, d, 5000))


_TAXA = """nodes AS (SELECT 1 AS tax_id, 1 AS parent_id, 'no rank' AS rank, 'root' AS name
  UNION ALL SELECT 10 + r_regionkey, 1, CASE r_regionkey % 2 WHEN 0 THEN 'phylum' ELSE 'class' END, r_name FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, CASE n_nationkey % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'family' ELSE 'clade' END, n_name FROM nation
  UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey, 'genus', s_name FROM supplier
  UNION ALL SELECT 100000000 + c_custkey, 1000 + c_custkey % (SELECT count(*) FROM supplier), 'species', c_name FROM customer)"""


@query(
    "p12_lineage",
    f"""WITH RECURSIVE {_TAXA}, ids AS (SELECT DISTINCT 100000000 + o_custkey AS tax_id FROM orders),
  up AS (SELECT tax_id, tax_id AS at FROM ids UNION ALL SELECT up.tax_id, n.parent_id FROM up JOIN nodes n ON n.tax_id = up.at WHERE n.parent_id <> n.tax_id)
  SELECT up.tax_id, {", ".join(f"coalesce(max(name) FILTER (rank = '{r}'), '') AS " + f'"{c}"' for r, c in (("phylum", "phylum"), ("class", "superorder"), ("order", "order"), ("family", "family"), ("genus", "genus"), ("species", "genus_species")))}
  FROM up JOIN nodes ON nodes.tax_id = up.at GROUP BY up.tax_id""",
)
def lineage(spark, d):
    region, nation = I.table(spark, d, "region"), I.table(spark, d, "nation")
    supplier, customer = I.table(spark, d, "supplier"), I.table(spark, d, "customer")
    n = supplier.agg(F.count(F.lit(1))).scalar()
    columns = ["tax_id", "parent_id", "rank", "name"]

    def level(df, *parts):
        return df.select(*[p.cast("bigint").alias(c) if c.endswith("_id") else p.alias(c) for p, c in zip(parts, columns)])

    nodes = (
        level(spark.range(1), F.lit(1), F.lit(1), F.lit("no rank"), F.lit("root"))
        .unionByName(level(region, F.col("r_regionkey") + 10, F.lit(1), F.when(F.col("r_regionkey") % 2 == 0, "phylum").otherwise("class"), F.col("r_name")))
        .unionByName(level(nation, F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, F.when(F.col("n_nationkey") % 3 == 0, "order").when(F.col("n_nationkey") % 3 == 1, "family").otherwise("clade"), F.col("n_name")))
        .unionByName(level(supplier, F.col("s_suppkey") + 1000, F.col("s_nationkey") + 100, F.lit("genus"), F.col("s_name")))
        .unionByName(level(customer, F.col("c_custkey") + 100000000, F.col("c_custkey") % n + 1000, F.lit("species"), F.col("c_name")))
    )
    ids = I.table(spark, d, "orders").select((F.col("o_custkey") + 100000000).alias("tax_id")).distinct()
    return T.lineage(ids, stored(nodes))


def trees(spark, d):
    """A tree per nation: its suppliers as accessions, with support and lengths."""
    k = F.col("s_suppkey")
    tip = F.concat(F.lit("GCA_"), k, F.lit(".1:0."), k % 10 + 1)
    tips = F.array_sort(F.collect_list(F.struct(k, tip.alias("t"))))
    joined = F.array_join(F.transform(tips, lambda x: x["t"]), ",")
    return I.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("tree_id")).agg(
        F.concat(F.lit("(("), joined, F.lit(")95:0.5,(x1:1e-05,y|GCA_1.1:2)87.5:-0.25)100;")).alias("newick")
    )


TREES_SQL = """trees AS (SELECT s_nationkey AS tree_id, string_agg('GCA_' || s_suppkey || '.1:0.' || (s_suppkey % 10 + 1), ',' ORDER BY s_suppkey) AS tips FROM supplier GROUP BY s_nationkey)"""


@query(
    "p18_clean_newick",
    """WITH t AS (SELECT s_nationkey AS tree_id, string_agg(CASE WHEN s_suppkey % 3 <> 0 THEN 'Genus_sp' || s_suppkey ELSE 'GCA_' || s_suppkey || '.1' END
    || ':0.' || (s_suppkey % 10 + 1), ',' ORDER BY s_suppkey) AS tips, count(*) FILTER (s_suppkey % 3 <> 0) AS n_replaced FROM supplier GROUP BY s_nationkey)
  SELECT tree_id, '((' || tips || '):0.5,(x1:1e-05,y|GCA_1.1:2):-0.25);' AS newick, n_replaced FROM t""",
)
def clean_newick(spark, d):
    k = F.col("s_suppkey")
    mapping = I.table(spark, d, "supplier").where(k % 3 != 0).select(
        F.concat(F.lit("GCA_"), k, F.lit(".1")).alias("accession"), F.concat(F.lit("Genus_sp"), k).alias("species")
    )
    return T.clean_newick(trees(spark, d), mapping, keep_lengths=True)


@query(
    "p18_strip_lengths",
    """SELECT s_nationkey AS tree_id, '((' || string_agg('GCA_' || s_suppkey || '.1', ',' ORDER BY s_suppkey) || '),(x1,y|GCA_1.1));' AS newick
  FROM supplier GROUP BY s_nationkey""",
)
def strip_lengths(spark, d):
    return trees(spark, d).select("tree_id", T.strip_lengths(T.strip_support(F.col("newick"))).alias("newick"))


@query(
    "g02_newick_edges",
    """WITH n AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, 'GCA_' || s_suppkey || '.1' AS child, 'node_50' AS parent FROM supplier
  UNION ALL SELECT CAST(k AS VARCHAR), unnest(['x1', 'y|GCA_1.1']), 'node_51' FROM n UNION ALL SELECT CAST(k AS VARCHAR), unnest(['node_50', 'node_51']), 'ancestral' FROM n""",
)
def newick_edges(spark, d):
    return T.newick_edges(trees(spark, d).withColumn("first_id", F.lit(50)))


@query(
    "g02_tree_tokens",
    f"""WITH {TREES_SQL}, t AS (SELECT tree_id, regexp_extract_all('((' || tips || ')95:0.5,(x1:1e-05,y|GCA_1.1:2)87.5:-0.25)100;', '[(),:;]|[^(),:;]+') AS a FROM trees),
  u AS (SELECT tree_id, unnest(a) AS token, generate_subscripts(a, 1) - 1 AS place FROM t)
  SELECT tree_id, place, token, token NOT IN ('(', ')', ',', ':', ';') AND coalesce(lag(token) OVER (PARTITION BY tree_id ORDER BY place) IN ('(', ','), FALSE) AS label FROM u""",
)
def tree_tokens(spark, d):
    return T.tree_tokens(trees(spark, d)).select("tree_id", F.col("place").cast("bigint").alias("place"), "token", "label")


@query(
    "g02_newick_nodes",
    """WITH n AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS tree_id FROM supplier)
  SELECT CAST(s_nationkey AS VARCHAR) AS tree_id, 'GCA_' || s_suppkey || '.1' AS node, 'node_50' AS parent, TRUE AS tip, CAST(NULL AS DOUBLE) AS support, CAST('0.' || (s_suppkey % 10 + 1) AS DOUBLE) AS length FROM supplier
  UNION ALL SELECT tree_id, 'x1', 'node_51', TRUE, NULL, 0.00001 FROM n UNION ALL SELECT tree_id, 'y|GCA_1.1', 'node_51', TRUE, NULL, 2 FROM n
  UNION ALL SELECT tree_id, 'node_50', 'ancestral', FALSE, 95, 0.5 FROM n UNION ALL SELECT tree_id, 'node_51', 'ancestral', FALSE, 87.5, -0.25 FROM n
  UNION ALL SELECT tree_id, 'ancestral', NULL, FALSE, 100, NULL FROM n""",
)
def newick_nodes(spark, d):
    return T.newick_nodes(trees(spark, d).withColumn("first_id", F.lit(50)))


@query(
    "g02_internal_count",
    """SELECT CAST(k AS VARCHAR) AS tree_id, 2::BIGINT AS n_tree, 1::BIGINT AS n_log FROM (SELECT DISTINCT s_nationkey AS k FROM supplier) WHERE k % 2 = 1""",
)
def internal_count(spark, d):
    edges = T.newick_edges(trees(spark, d).withColumn("first_id", F.lit(50)))
    names = F.when(F.col("tree_id").cast("int") % 2 == 1, F.array(F.lit("node_50"))).otherwise(F.array(F.lit("node_50"), F.lit("node_51")))
    logged = trees(spark, d).select(F.col("tree_id").cast("string").alias("tree_id")).select("tree_id", F.explode(names).alias("child"))
    return T.check_internal_count(edges, logged)


@query(
    "p04_coerce_node",
    """SELECT c_custkey AS row_idx, CASE c_custkey % 6 WHEN 0 THEN 'ancestral' WHEN 1 THEN 'node_' || c_custkey WHEN 2 THEN 'node_' || c_custkey
  WHEN 3 THEN 'node_x' || c_custkey WHEN 4 THEN 'genus_sp' || c_custkey ELSE '' END AS node FROM customer""",
)
def coerce(spark, d):
    k = F.col("c_custkey")
    raw = (
        F.when(k % 6 == 0, " Root ").when(k % 6 == 1, F.concat(F.lit("Node  "), k)).when(k % 6 == 2, F.concat(F.lit("00"), k))
        .when(k % 6 == 3, F.concat(F.lit("NODE_X"), k)).when(k % 6 == 4, F.concat(F.lit("Genus Sp"), k, F.lit(" sub"))).otherwise(F.lit("  "))
    )
    return I.table(spark, d, "customer").select(k.alias("row_idx"), coerce_node(raw).alias("node"))


@query(
    "p19_relabel",
    f"""WITH {I.ALN_SQL}, m AS (SELECT 'taxon' || (s_suppkey % 60) AS a, any_value('Genus' || (s_suppkey % 60 % 9) || '_sp' || (s_suppkey % 60)) AS label FROM supplier WHERE s_suppkey % 60 % 4 <> 1 GROUP BY s_suppkey % 60)
  SELECT alignment, sequence_id, coalesce(label, sequence_id) AS label FROM aln LEFT JOIN m ON a = sequence_id""",
)
def relabel(spark, d):
    from baseloom.operators.traits import relabel as op

    k = F.col("s_suppkey") % 60
    mapping = I.table(spark, d, "supplier").where(k % 4 != 1).select(
        F.concat(F.lit("taxon"), k).alias("accession"), F.concat(F.lit("GENUS"), k % 9, F.lit(" Sp"), k, F.lit(" sub")).alias("organism_name")
    )
    return op(I.alignments(spark, d), mapping).select("alignment", "sequence_id", "label")


