"""Catalogue, cohorts, registries, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from baseloom.operators import catalog as C
from baseloom.operators import validate as V
from baseloom.session import stored
from workload import inputs as I
from workload.registry import query

ROOT = "split_part(accession, '.', 1)"


@query("p01_accession_parts", f"WITH {I.ASM_SQL} SELECT accession, {ROOT} AS accession_root, CAST(split_part(accession, '.', 2) AS BIGINT) AS accession_version FROM assemblies")
def accession_parts(spark, d):
    return C.with_accession_parts(I.assemblies(spark, d).select("accession"))


@query("p02_accession_aliases", f"WITH {I.ASM_SQL} SELECT accession, unnest([accession, {ROOT}]) AS alias FROM assemblies")
def aliases(spark, d):
    return C.accession_aliases(I.assemblies(spark, d).select("accession"))


_FLAT = """CASE WHEN o_orderkey % 3 = 0 THEN 'GCF_' ELSE 'GCA_' END || o_orderkey || '.1'"""


@query(
    "p11_flatten_assembly",
    f"""SELECT {_FLAT} AS accession, split_part({_FLAT}, '.', 1) AS accession_root, 'Genus' || (o_custkey % 60) || '  species' || (o_custkey % 300) AS organism_name,
  CAST(o_custkey AS VARCHAR) AS taxon_id, 'asm' || o_orderkey AS assembly_name, CASE o_orderkey % 5 WHEN 0 THEN 'chromosome' WHEN 1 THEN 'chromosome' ELSE o_orderpriority END AS assembly_level,
  CASE WHEN o_orderkey % 2 = 0 THEN 'representative genome' ELSE '' END AS refseq_category, CASE WHEN o_orderkey % 3 = 0 THEN 'RefSeq' ELSE 'GenBank' END AS source_database,
  o_orderkey % 3 = 0 AS is_refseq, true AS is_current_for_species, '' AS replaced_by_accession, 'Genus' || (o_custkey % 60) || '_species' || (o_custkey % 300) AS species_key, 'reptiles' AS ncbi_search_term, '' AS notes FROM orders""",
)
def flatten(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = I.table(spark, d, "orders").select(
        F.concat(F.when(k % 3 == 0, "GCF_").otherwise("GCA_"), k, F.lit(".1")).alias("accession"),
        F.struct(F.concat(F.lit("Genus"), c % 60, F.lit("  species"), c % 300).alias("organism_name"), c.alias("tax_id")).alias("organism"),
        F.struct(
            F.concat(F.lit("asm"), k).alias("assembly_name"),
            F.when(k % 5 == 0, F.lit("")).when(k % 5 > 1, F.col("o_orderpriority")).alias("assembly_level"),
            F.when(k % 2 == 0, "representative genome").alias("refseq_category"),
        ).alias("assembly_info"),
    )
    return C.flatten_assembly(raw, "2026-01-01 00:00:00", "reptiles").drop("downloaded_at", "metadata_last_updated")


@query(
    "f01_select_accessions",
    f"""WITH {I.ASM_SQL}, l AS (SELECT min(accession) AS accession FROM assemblies) SELECT accession, CAST(0 AS BIGINT) AS place FROM l
  UNION ALL (SELECT accession, row_idx + 1 FROM assemblies WHERE accession NOT IN (SELECT accession FROM l) ORDER BY row_idx LIMIT 40)""",
)
def select_extra(spark, d):
    manifest = I.assemblies(spark, d).select("accession", "row_idx")
    smallest = manifest.agg(F.min("accession").alias("a")).first()["a"]
    return C.select_accessions(manifest, "extra", default=[smallest], n=40)


@query("f01_select_all", f"WITH {I.ASM_SQL} SELECT accession, row_idx AS place FROM assemblies")
def select_all(spark, d):
    return C.select_accessions(I.assemblies(spark, d).select("accession", "row_idx"), "all")


def _allowed(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return (
        I.table(spark, d, "orders")
        .where(c % 3 == 1)
        .select(F.concat(F.when(k % 3 == 0, "GCF_").otherwise("GCA_"), F.lpad((c + c % 2).cast("string"), 9, "0"), F.lit("."), k % 4 + k % 2 * 3).alias("accession"))
        .distinct()
    )


_ALLOWED = """allowed AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'GCF_' ELSE 'GCA_' END || lpad(CAST(o_custkey + o_custkey % 2 AS VARCHAR), 9, '0') || '.' || (o_orderkey % 4 + o_orderkey % 2 * 3) AS accession
  FROM orders WHERE o_custkey % 3 = 1)"""
_COHORT = f"""{I.ASM_SQL}, {_ALLOWED}, parts AS (SELECT *, {ROOT} AS accession_root, CAST(split_part(accession, '.', 2) AS BIGINT) AS accession_version FROM assemblies),
  roots AS (SELECT DISTINCT {ROOT} AS accession_root FROM allowed), exact AS (SELECT * FROM parts WHERE accession IN (SELECT accession FROM allowed)),
  cohort AS (SELECT * FROM (SELECT * FROM exact UNION ALL SELECT * FROM parts WHERE accession_root IN (SELECT accession_root FROM roots) AND accession_root NOT IN (SELECT accession_root FROM exact))
    QUALIFY row_number() OVER (PARTITION BY accession_root ORDER BY accession_version DESC, accession) = 1)"""


@query("f02_resolve_cohort", f"WITH {_COHORT} SELECT accession_root, accession, accession_version FROM cohort")
def cohort(spark, d):
    return C.resolve_cohort(I.assemblies(spark, d), _allowed(spark, d)).select("accession_root", "accession", "accession_version")


@query("f02_missing_roots", f"WITH {_COHORT} SELECT accession_root FROM roots WHERE accession_root NOT IN (SELECT accession_root FROM cohort)")
def missing_roots(spark, d):
    allowed = _allowed(spark, d)
    return C.missing_roots(C.resolve_cohort(I.assemblies(spark, d), allowed), allowed)


@query("f03_exact_cohort", f"WITH {_COHORT} SELECT accession FROM exact")
def exact(spark, d):
    return C.exact_cohort(I.assemblies(spark, d), _allowed(spark, d)).select("accession")


@query("f03_missing", f"WITH {_COHORT} SELECT accession FROM allowed WHERE accession NOT IN (SELECT accession FROM assemblies)")
def missing_exact(spark, d):
    return C.missing_from(_allowed(spark, d), I.assemblies(spark, d))


@query("f04_new_entries", f"WITH {_COHORT} SELECT accession FROM assemblies WHERE accession NOT IN (SELECT accession FROM allowed)")
def new_entries(spark, d):
    return C.new_entries(I.assemblies(spark, d).select("accession"), _allowed(spark, d))


@query(
    "f05_project_accessions",
    """WITH s AS (SELECT 'GCA_' || c_custkey AS accession, 0 AS source, c_custkey AS row_idx FROM customer WHERE c_custkey % 4 = 0 UNION ALL
  SELECT 'GCA_' || s_suppkey * 2, 1, s_suppkey FROM supplier UNION ALL SELECT 'GCA_' || p_partkey, 2, p_partkey FROM part)
  SELECT accession, source::BIGINT AS source, row_idx FROM s QUALIFY row_number() OVER (PARTITION BY accession ORDER BY source, row_idx) = 1""",
)
def project_accessions(spark, d):
    c, s, p = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey")
    tag = F.lit(" GCA_")
    return C.project_accessions(
        I.table(spark, d, "customer").where(c % 4 == 0).select(F.concat(tag, c).alias("accession"), c.alias("row_idx")),
        I.table(spark, d, "supplier").select(F.concat(tag, s * 2).alias("accession"), s.alias("row_idx")),
        I.table(spark, d, "part").select(F.concat(tag, p, F.lit(" ")).alias("accession"), p.alias("row_idx")),
        fallback=I.table(spark, d, "region").select(F.lit("never").alias("accession"), F.col("r_regionkey").alias("row_idx")),
    )


@query("f10_lookup_genome", "SELECT 'GCA_' || max(c_custkey) AS accession FROM customer")
def lookup(spark, d):
    c = F.col("c_custkey")
    meta = I.table(spark, d, "customer").select(F.concat(F.lit("GCA_"), c).alias("accession"), F.concat(F.lit("/x/"), c).alias("path_to_fna"), F.concat(F.lit("Genus Species"), c).alias("organism_name"))
    n = I.table(spark, d, "customer").agg(F.max(c)).first()[0]
    return C.lookup_genome(meta, f"genus species{n}").select("accession")


@query("f11_retry_queue", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS accession FROM events WHERE event_type = 'error'")
def retry(spark, d):
    return C.retry_queue(I.table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit(" "), "user_id").alias("accession")))


@query("f11_drop_resolved", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0)")
def drop_resolved(spark, d):
    events = I.table(spark, d, "events").withColumn("accession", F.col("user_id"))
    done = events.where("event_type = 'purchase' AND user_id % 2 = 0")
    return C.drop_resolved(events.where("event_type = 'error'"), done).select("event_id")


@query("j01_attach_fasta", f"WITH {I.ASM_SQL} SELECT accession, '/g/' || accession || '.fna' AS path_to_fna FROM assemblies")
def attach(spark, d):
    rows = I.assemblies(spark, d).select("accession")
    paths = rows.withColumn("path_to_fna", F.concat(F.lit("/g/"), "accession", F.lit(".fna")))
    return C.attach_fasta(rows, paths)


@query("j24_missing_from", f"WITH {_COHORT} SELECT DISTINCT accession FROM assemblies WHERE accession NOT IN (SELECT accession FROM allowed)")
def coverage(spark, d):
    return C.uncovered_accessions(I.assemblies(spark, d), _allowed(spark, d))


def _runs(spark, d):
    c, p = F.col("c_custkey"), F.col("p_partkey")
    assemblies = I.table(spark, d, "customer").select(
        F.concat(F.lit("GCA_"), c).alias("accession"), F.concat(F.lit("Genus Sp"), c, F.lit(" sub")).alias("organism_name"),
        F.when(c % 3 == 0, F.concat(F.lit("/a/"), c)).when(c % 3 == 1, F.lit("")).alias("path_to_fna"), F.when(c % 4 > 0, F.concat(F.lit("/b/"), c)).alias("pathway_to_genome"),
    )
    features = I.table(spark, d, "part").select(F.concat(F.lit("GCA_"), p).alias("accession"), F.when(p % 2 == 0, "odb12").alias("lineage"))
    return features, assemblies


_RUNS = "g AS (SELECT 'GCA_' || c_custkey AS accession, 'Genus_Sp' || c_custkey AS species, coalesce(CASE WHEN c_custkey % 3 = 0 THEN '/a/' || c_custkey END, CASE WHEN c_custkey % 4 > 0 THEN '/b/' || c_custkey END) AS genome_fna FROM customer)"


@query("j25_run_manifest", f"WITH {_RUNS} SELECT accession, species, genome_fna, CASE WHEN p_partkey % 2 = 0 THEN 'odb12' ELSE 'base' END AS lineage FROM g JOIN part ON accession = 'GCA_' || p_partkey WHERE genome_fna IS NOT NULL")
def run_manifest(spark, d):
    return C.build_run_manifest(*_runs(spark, d), "base")


@query("j25_run_manifest_fallback", f"WITH {_RUNS} SELECT accession, species, genome_fna, 'base' AS lineage FROM g WHERE genome_fna IS NOT NULL")
def run_manifest_fallback(spark, d):
    return C.build_run_manifest(None, _runs(spark, d)[1], "base")


@query(
    "j25_run_warnings",
    f"""WITH {_RUNS} SELECT 'GCA_' || p_partkey AS accession, 'accession_missing' AS warning FROM part WHERE 'GCA_' || p_partkey NOT IN (SELECT accession FROM g)
  UNION ALL SELECT accession, 'no_genome_path' FROM g WHERE genome_fna IS NULL AND accession IN (SELECT 'GCA_' || p_partkey FROM part)""",
)
def run_warnings(spark, d):
    return C.run_manifest_warnings(*_runs(spark, d))


@query("a24_multi_accession", f"WITH {I.ASM_SQL} SELECT organism_name, accession, row_idx, n_accessions FROM (SELECT *, count(*) OVER (PARTITION BY organism_name) AS n_accessions FROM assemblies) WHERE n_accessions > 1")
def multi(spark, d):
    return C.multi_accession(I.assemblies(spark, d))


@query("a34_status_tally", "SELECT CASE WHEN event_type <> 'error' THEN 'SUCCESS' ELSE 'FAILED' END AS status, count(*) AS n FROM events GROUP BY ALL")
def tally(spark, d):
    return C.status_tally(I.table(spark, d, "events"), F.col("event_type") != "error")


_CURRENT = f"""cur AS (SELECT accession, sk AS species_key, accession = best AS is_current_for_species, CASE WHEN accession = best THEN '' ELSE best END AS replaced_by_accession, organism_name
  FROM (SELECT *, first_value(accession) OVER (PARTITION BY sk ORDER BY CASE WHEN accession LIKE 'GCF%' THEN 0 ELSE 1 END, accession DESC) AS best
    FROM (SELECT *, coalesce(nullif(species_key, ''), {ROOT}) AS sk FROM assemblies)))"""


def current(spark, d):
    return C.current_assemblies(I.assemblies(spark, d))


@query("w03_current_assemblies", f"WITH {I.ASM_SQL}, {_CURRENT} SELECT accession, species_key, is_current_for_species, replaced_by_accession FROM cur")
def current_assemblies(spark, d):
    return current(spark, d).select("accession", "species_key", "is_current_for_species", "replaced_by_accession")


def _updates(spark, d):
    base = current(spark, d).select("accession", "species_key", "organism_name", "is_current_for_species", "replaced_by_accession", "row_idx")
    old = base.where("row_idx % 5 <> 0").drop("row_idx")
    new = base.where("row_idx % 5 = 0 OR row_idx % 11 = 0").withColumn("is_current_for_species", F.lit(True)).withColumn("replaced_by_accession", F.lit("")).withColumnRenamed("row_idx", "seq")
    return stored(old), stored(new)


_UPDATES = f"""{I.ASM_SQL}, {_CURRENT.replace('organism_name\n', 'organism_name, row_idx\n')}, olds AS (SELECT * FROM cur WHERE row_idx % 5 <> 0), news AS (SELECT * FROM cur WHERE row_idx % 5 = 0 OR row_idx % 11 = 0),
  state AS (SELECT accession, species_key, organism_name, is_current_for_species, replaced_by_accession, -1 AS seq FROM olds WHERE accession NOT IN (SELECT accession FROM news)
    UNION ALL SELECT accession, species_key, organism_name, true, '', row_idx FROM news)"""


@query(
    "w04_apply_updates",
    f"""WITH {_UPDATES} SELECT s.accession, s.species_key, s.organism_name, s.is_current_for_species AND max(n.row_idx) IS NULL AS is_current_for_species,
  coalesce(max_by(n.accession, n.row_idx), s.replaced_by_accession) AS replaced_by_accession FROM state s LEFT JOIN news n ON n.species_key = s.species_key AND n.accession <> s.accession AND n.row_idx > s.seq
  GROUP BY s.accession, s.species_key, s.organism_name, s.is_current_for_species, s.replaced_by_accession, s.seq""",
)
def apply_updates(spark, d):
    return C.apply_updates(*_updates(spark, d))


@query(
    "w04_supersession_events",
    f"""WITH {_UPDATES}, b AS (SELECT species_key, accession, min(seq) AS since FROM (SELECT species_key, accession, -1 AS seq FROM olds UNION ALL SELECT species_key, accession, row_idx FROM news) GROUP BY ALL)
  SELECT n.species_key, n.accession AS new_accession, n.row_idx AS seq, count(*) AS n_superseded FROM news n JOIN b ON b.species_key = n.species_key AND b.accession <> n.accession AND b.since < n.row_idx GROUP BY ALL""",
)
def events(spark, d):
    return C.supersession_events(*_updates(spark, d))


@query("w08_dedupe_refseq", f"WITH {I.ASM_SQL} SELECT organism_name, max(accession) AS accession FROM assemblies GROUP BY ALL")
def dedupe_refseq(spark, d):
    return C.dedupe_refseq(I.assemblies(spark, d))


@query("c01_append_catalog", f"WITH {_COHORT} SELECT accession, row_idx FROM assemblies WHERE row_idx % 2 = 0 OR accession IN (SELECT accession FROM allowed)")
def append_catalog(spark, d):
    rows = I.assemblies(spark, d).select("accession", "row_idx")
    return C.append_catalog(rows.where("row_idx % 2 = 0"), rows.where("row_idx % 2 <> 0"), _allowed(spark, d))


@query("c02_species_index", f"WITH {I.ASM_SQL}, {_CURRENT} SELECT species_key, organism_name, accession, CASE WHEN is_current_for_species THEN 'current' ELSE 'superseded' END AS status, replaced_by_accession, '0' AS project_count, '' AS notes FROM cur")
def species_index(spark, d):
    return C.species_index(current(spark, d))


@query(
    "c03_project_manifest",
    f"""WITH {_COHORT}, {_CURRENT} SELECT 'p' AS project_name, 'frozen' AS project_policy, 'v1' AS manifest_version, DATE '2026-01-31' AS manifest_date, species_key, organism_name, accession,
  'focal' AS project_role, is_current_for_species AS is_current_for_species_at_freeze FROM cur WHERE accession IN (SELECT accession FROM allowed)""",
)
def project_manifest(spark, d):
    return C.project_manifest(current(spark, d), _allowed(spark, d), "p", "frozen", "v1", "2026-01-31")


@query("c04_registry_upsert", "SELECT c_custkey AS project_name, CASE WHEN p_partkey IS NULL THEN c_mktsegment ELSE p_type END AS notes FROM customer LEFT JOIN part ON p_partkey = c_custkey AND p_size < 20 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size < 20 AND p_partkey NOT IN (SELECT c_custkey FROM customer)")
def registry_upsert(spark, d):
    old = I.table(spark, d, "customer").select(F.col("c_custkey").alias("project_name"), F.col("c_mktsegment").alias("notes"))
    new = I.table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("project_name"), F.col("p_type").alias("notes"))
    return C.upsert(old, new, ["project_name"])


@query(
    "c05_upsert_metadata",
    """WITH o AS (SELECT DISTINCT l_partkey AS accession, l_returnflag AS lineage, 'x' AS cds_fasta FROM lineitem), n AS (SELECT DISTINCT l_partkey AS accession, l_linestatus AS lineage, CASE WHEN l_partkey % 2 = 0 THEN 'x' ELSE 'y' END AS cds_fasta FROM lineitem WHERE l_quantity < 3)
  SELECT * FROM n UNION ALL SELECT * FROM o WHERE (accession, lineage) NOT IN (SELECT (accession, lineage) FROM n)""",
)
def upsert_metadata(spark, d):
    li = I.table(spark, d, "lineitem")
    old = li.select(F.col("l_partkey").alias("accession"), F.col("l_returnflag").alias("lineage"), F.lit("x").alias("cds_fasta"))
    new = li.where("l_quantity < 3").select(F.col("l_partkey").alias("accession"), F.col("l_linestatus").alias("lineage"), F.when(F.col("l_partkey") % 2 == 0, "x").otherwise("y").alias("cds_fasta"))
    return C.upsert_metadata(old, new)


@query(
    "c06_rebuild_catalog",
    f"""WITH {_COHORT}, j AS (SELECT l.accession, coalesce(organism_name, '') AS organism_name, coalesce(nullif(species_key, ''), split_part(l.accession, '.', 1)) AS species_key, coalesce(assembly_level, '') AS assembly_level,
    CASE WHEN organism_name IS NULL THEN 'local only' ELSE '' END AS notes FROM (SELECT accession FROM allowed UNION SELECT accession FROM assemblies WHERE row_idx % 3 = 0) l LEFT JOIN assemblies a ON a.accession = l.accession)
  SELECT *, accession = best AS is_current_for_species, CASE WHEN accession = best THEN '' ELSE best END AS replaced_by_accession FROM (SELECT *, first_value(accession) OVER (PARTITION BY species_key ORDER BY CASE WHEN accession LIKE 'GCF%' THEN 0 ELSE 1 END, accession DESC) AS best FROM j)""".replace(
        "SELECT *, accession = best", "SELECT * EXCLUDE (best), accession = best"
    ),
)
def rebuild(spark, d):
    rows = I.assemblies(spark, d)
    local = _allowed(spark, d).unionByName(rows.where("row_idx % 3 = 0").select("accession"))
    return C.rebuild_catalog(local, rows)


@query(
    "u02_rebuild_diff",
    f"""WITH {_COHORT} SELECT accession, 'missing' AS change FROM assemblies WHERE accession NOT IN (SELECT accession FROM allowed) UNION ALL
  SELECT accession, 'new' FROM allowed WHERE accession NOT IN (SELECT accession FROM assemblies)""",
)
def rebuild_diff(spark, d):
    return C.rebuild_diff(I.assemblies(spark, d), _allowed(spark, d))


@query(
    "v02_check_fk",
    """WITH lost AS (SELECT c_custkey + 10 AS r FROM customer WHERE c_custkey + 10 NOT IN (SELECT c_custkey FROM customer)) SELECT 'customer.next' AS relation, count(*) AS n_missing,
  (SELECT string_agg(r, ', ' ORDER BY r) FROM (SELECT DISTINCT r FROM lost ORDER BY r LIMIT 10)) AS examples FROM lost""",
)
def check_fk(spark, d):
    customer = I.table(spark, d, "customer")
    child = customer.select((F.col("c_custkey") + 10).alias("next"))
    return V.check_fk(child, "next", customer, "c_custkey", "customer.next")


@query(
    "v03_check_one_to_one",
    """SELECT c_custkey + 10 AS k, 'missing_in_second' AS problem FROM customer WHERE c_custkey + 10 NOT IN (SELECT o_custkey FROM orders) UNION ALL
  SELECT o_custkey, 'missing_in_first' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey + 10 FROM customer)""",
)
def one_to_one(spark, d):
    return V.check_one_to_one(
        I.table(spark, d, "customer").select((F.col("c_custkey") + 10).alias("k")), I.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k"
    )


@query("v04_check_pk", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def check_pk(spark, d):
    return V.check_pk(I.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def _star(spark, d):
    rename = {
        "natural_history": ("nation", {"n_nationkey": "species_pk"}),
        "genomes": ("customer", {"c_custkey": "genome_pk", "c_nationkey": "species_pk"}),
        "sequences": ("orders", {"o_orderkey": "sequence_pk", "o_custkey": "genome_pk"}),
        "genomic_windows": ("lineitem", {"l_orderkey": "sequence_pk", "l_partkey": "window_pk"}),
        "gc_window_stats": ("part", {"p_partkey": "window_pk"}),
    }
    out = {}
    for name, (source, columns) in rename.items():
        out[name] = I.table(spark, d, source).select(*[F.col(a).alias(b) for a, b in columns.items()])
    out["natural_history"] = out["natural_history"].where("species_pk % 4 <> 1")
    out["sequences"] = out["sequences"].where("sequence_pk % 50 <> 7")
    return out


@query(
    "v05_orphan_report",
    """SELECT 'genomes.species_pk' AS relation, count(*) AS n_orphans FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 <> 1)
  UNION ALL SELECT 'sequences.genome_pk', count(*) FROM orders WHERE o_orderkey % 50 <> 7 AND o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'genomic_windows.sequence_pk', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 7)
  UNION ALL SELECT 'gc_window_stats.window_pk', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""",
)
def orphans(spark, d):
    return V.orphan_report(_star(spark, d))


@query("v06_join_validated", "SELECT o_orderkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_validated(spark, d):
    customer = I.table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return V.join_validated(I.table(spark, d, "orders"), customer, ["o_custkey"], "left", "m:1").select("o_orderkey", "c_nationkey")


@query("v08_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("customer", "orders", "lineitem", "documents")))
def row_counts(spark, d):
    return V.row_counts({t: I.table(spark, d, t) for t in ("customer", "orders", "lineitem", "documents")})


