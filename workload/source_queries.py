"""Sources and sinks: tables go out as files and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from baseloom.session import scratch_path, spread
from baseloom.sources import fasta as FA
from baseloom.sources import pages as PG
from baseloom.sources import sinks as SK
from baseloom.sources import tables as TB
from baseloom.sources import trees_text as TT
from workload import inputs as I
from workload.registry import query, rounded
from workload.window_queries import TUMBLING, tumbling, windows_sql

BLOCK, SLAB, CHUNK = 100_000, 30_000, 5_000


def genome_fasta(spark, d) -> str:
    """All documents as wrapped FASTA records, in as many files as tasks."""
    path = scratch_path(spark, "genome")
    body = F.regexp_replace("bases", "(.{60})", "$1\n")
    record = F.concat(F.lit(">seq_"), "doc_id", F.lit(" from "), "source", F.lit("\n"), body)
    docs = spread(I.table(spark, d, "documents").select("doc_id", "text", "source"))
    docs.withColumn("bases", I.dna_of(F.col("text"))).select(record.alias("value")).write.text(path)
    return path + "/*.txt"


@query(
    "src05_fasta_chunks",
    f"""WITH {I.DNA_SQL} SELECT 'seq_' || doc_id AS sequence_id, CAST(c AS BIGINT) AS chunk_no, md5(substring(bases, c * {CHUNK} + 1, {CHUNK})) AS digest
  FROM (SELECT doc_id, bases, unnest(range(0, (length(bases) + {CHUNK - 1}) // {CHUNK})) AS c FROM dna)""",
)
def fasta_chunks(spark, d):
    chunks = FA.read_fasta_chunks(spark, genome_fasta(spark, d), CHUNK, BLOCK, SLAB)
    return chunks.select("sequence_id", "chunk_no", F.md5("bases").alias("digest"))


@query(
    "src05_fasta_catalogue",
    f"""WITH {I.DNA_SQL} SELECT 'seq_' || doc_id AS sequence_id, 'seq_' || doc_id || ' from ' || source AS long_name, CAST(length(bases) AS BIGINT) AS sequence_length
  FROM dna JOIN documents USING (doc_id)""",
)
def fasta_catalogue(spark, d):
    return FA.fasta_catalogue(spark, genome_fasta(spark, d), BLOCK, SLAB).select("sequence_id", "long_name", "sequence_length")


@query("src06_gene_fasta", f"WITH {I.CDS_SQL} SELECT gene, seq FROM cds")
def gene_fasta(spark, d):
    path = scratch_path(spark, "genes")
    first = F.concat(F.lit(">"), "gene", F.lit(" old\nACGT\n"))
    second = F.concat(F.lit(">"), "gene", F.lit(" new\n--"), F.lower("seq"), F.lit("-"))
    I.cds(spark, d).select(F.concat(first, second).alias("value")).write.text(path)
    return FA.read_gene_fasta(spark, path + "/*.txt", BLOCK * 10).select("gene", "seq")


@query("src07_alignments", f"WITH {I.DNA_SQL} SELECT 'seq_' || doc_id AS sequence_id, md5(replace(bases, 'N', '-')) AS digest FROM dna")
def alignment_files(spark, d):
    path = scratch_path(spark, "alignments")
    record = F.concat(F.lit(">seq_"), "doc_id", F.lit("\n"), F.replace("bases", F.lit("N"), F.lit("-")))
    I.dna(spark, d).select(record.alias("value")).write.text(path)
    return FA.read_alignments(spark, path + "/*.txt", BLOCK, SLAB).select("sequence_id", F.md5("seq").alias("digest"))


def full_table_lines(spark, d):
    """Gene-table lines of the gene models, each after a stale line of its gene."""
    number = F.substring("gene", 2, 20).cast("bigint")
    tokens = F.array_join(
        F.transform("exons", lambda e: F.concat_ws("_", F.when(number % 2 == 0, e["end"]).otherwise(e["start"]), F.when(number % 2 == 0, e["start"]).otherwise(e["end"]), F.col("strand"))), "|"
    )
    tokens = F.when(number % 6 == 0, F.concat(tokens, F.lit("|5_9_x|abc"))).otherwise(tokens)
    low = F.when(number % 4 == 0, F.concat((F.col("start") - 5).cast("string"), F.lit(".0"))).when(number % 4 == 1, "bad").otherwise("")
    high = F.when(number % 4 < 2, F.col("end") + 5).cast("string")
    line = F.concat_ws("\t", "gene", "status", "sequence_id", F.lit("0"), F.lit("0"), "strand", F.lit("."), F.lit("."), F.lit("."), low, F.coalesce(high, F.lit("")), F.lit("."), tokens)
    stale = F.concat(F.col("gene"), F.lit("\tMissing\t\t\t\t"))
    lines = F.array(F.lit("# comment"), stale, line)
    return I.models(spark, d).select(number.alias("n"), F.posexplode(lines).alias("line_no", "value"))


@query(
    "src08_full_table",
    f"""WITH {I.MODELS_SQL} SELECT gene, status, sequence_id, strand, CASE WHEN gene_no % 4 = 0 THEN "start" - 5 ELSE "start" END AS "start", CASE WHEN gene_no % 4 = 0 THEN "end" + 5 ELSE "end" END AS "end",
  (SELECT count(*) FROM exons e WHERE e.gene_no = models.gene_no) AS n_exons, gene_no % 6 <> 0 AS valid FROM models""",
)
def full_table(spark, d):
    path = scratch_path(spark, "full-table")
    # The lines of a gene come from one row, so they follow each other in the file as they are.
    full_table_lines(spark, d).select("value").write.text(path)
    parsed = TB.read_full_table(spark, path)
    return parsed.select("gene", "status", "sequence_id", "strand", "start", "end", F.size("exons").cast("bigint").alias("n_exons"), "valid")


@query("src01_read_delimited", "SELECT c_custkey::VARCHAR AS species_pk, c_name AS name, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS segment FROM customer")
def read_delimited(spark, d):
    path = scratch_path(spark, "customer") + ".tsv"
    out = I.table(spark, d, "customer").select(
        F.col("c_custkey").cast("double").alias("species_pk"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).otherwise("NaN").alias("segment"), F.lit(1).alias("extra")
    )
    SK.write_tsv(out, path, ["species_pk", "name", "segment"])
    return TB.read_delimited(spark, path, null="\\N")


@query("snk01_write_tsv", "SELECT c_custkey::VARCHAR || chr(9) || c_name || chr(9) || CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment ELSE '\\N' END || chr(9) || '\\N' AS line FROM customer")
def write_tsv(spark, d):
    path = scratch_path(spark, "customer") + ".tsv"
    out = I.table(spark, d, "customer").select(
        F.col("c_custkey").cast("double").alias("species_pk"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).otherwise(" null ").alias("segment")
    )
    SK.write_tsv(out, path, ["species_pk", "name", "segment", "missing"], header=False)
    return spark.read.text(path).select(F.col("value").alias("line"))


_CHUNK_COLUMNS = ["window_pk", "sequence_pk", "start_bp", "end_bp", "gc_prop", "keep_flag"]


def window_chunks(spark, d, root: str):
    windows = tumbling(spark, d).withColumn("run_pk", F.lit(1)).withColumn("accession_id", F.concat(F.lit("GCF 00"), "genome_pk"))
    windows = windows.withColumn("window_pk", F.col("sequence_pk") * 1000000 + F.col("start_bp"))
    return SK.write_chunks(windows, root, "genomic_windows", _CHUNK_COLUMNS)


@query(
    "snk02_chunk_manifest",
    f"""WITH {windows_sql(TUMBLING)} SELECT 'genomic_windows' AS table_name, CAST(1 AS BIGINT) AS run_pk, genome_pk, 'GCF_00' || genome_pk AS accession_id, standard_window_size_bp, step_size_bp, count(*) AS n_rows
  FROM win GROUP BY ALL""",
)
def chunk_manifest(spark, d):
    manifest = window_chunks(spark, d, scratch_path(spark, "chunks"))
    keys = ["table_name", "run_pk", "genome_pk", "accession_id", "standard_window_size_bp", "step_size_bp"]
    return manifest.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"))


@query(
    "src02_scan_chunks",
    f"""WITH {windows_sql(TUMBLING)} SELECT CAST(sequence_pk * 1000000 + start_bp AS VARCHAR) AS window_pk, CAST(sequence_pk AS VARCHAR) AS sequence_pk, CAST(start_bp AS VARCHAR) AS start_bp, CAST(end_bp AS VARCHAR) AS end_bp FROM win""",
)
def scan_chunks(spark, d):
    root = scratch_path(spark, "tables")
    window_chunks(spark, d, root)
    SK.write_tsv(I.table(spark, d, "nation").select(F.col("n_nationkey").alias("window_pk")), f"{root}/genomic_windows.tsv", _CHUNK_COLUMNS)
    return TB.scan_table(spark, root, "genomic_windows").select("window_pk", "sequence_pk", "start_bp", "end_bp")


@query("src02_scan_ragged", "SELECT CAST(c_custkey AS VARCHAR) AS species_pk, c_name AS name, NULL AS segment FROM customer UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, p_type FROM part")
def scan_ragged(spark, d):
    root = scratch_path(spark, "tables")
    SK.write_tsv(I.table(spark, d, "customer").select(F.col("c_custkey").alias("species_pk"), F.col("c_name").alias("name")), f"{root}/natural_history.tsv", ["species_pk", "name"])
    SK.write_tsv(I.table(spark, d, "part").select(F.col("p_partkey").alias("species_pk"), F.col("p_type").alias("segment")), f"{root}/natural_history", ["species_pk", "segment"])
    return TB.scan_table(spark, root, "natural_history")


def _summaries(spark, d):
    """Assembly summaries as JSON lines; an accession may come several times."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    record = F.to_json(
        F.struct(
            F.concat(F.lit("GCA_"), c, F.lit(".1")).alias("accession"),
            F.struct(F.concat(F.lit("Genus sp"), k).alias("organism_name"), c.alias("tax_id")).alias("organism"),
            F.struct(F.concat(F.lit("asm"), k).alias("assembly_name"), F.col("o_orderpriority").alias("assembly_level")).alias("assembly_info"),
        )
    )
    return I.table(spark, d, "orders").select(c.alias("c"), k.alias("k"), F.posexplode(F.array(record, F.lit(""))).alias("i", "value"))


@query(
    "src03_assembly_jsonl",
    """SELECT 'GCA_' || o_custkey || '.1' AS accession, 'Genus sp' || max(o_orderkey) AS organism_name, o_custkey AS tax_id, 'asm' || max(o_orderkey) AS assembly_name, max_by(o_orderpriority, o_orderkey) AS assembly_level FROM orders GROUP BY o_custkey""",
)
def assembly_jsonl(spark, d):
    path = scratch_path(spark, "summaries")
    _summaries(spark, d).repartition("c").sortWithinPartitions("c", "k", "i").select("value").write.text(path)
    df = TB.read_assembly_jsonl(spark, path)
    return df.select("accession", "organism.organism_name", "organism.tax_id", "assembly_info.assembly_name", "assembly_info.assembly_level")


@query(
    "src04_assembly_stats",
    """SELECT 'GCA_' || o_custkey AS accession_id, nullif(k % 30, 0) AS ncbi_total_chromosomes, k AS ncbi_number_scaffolds, CAST(NULL AS BIGINT) AS ncbi_number_contigs, nullif(k % 7, 0) AS ncbi_component_sequences
  FROM (SELECT o_custkey, nullif(min(o_orderkey), 0) AS k0, min(o_orderkey) AS k FROM orders GROUP BY o_custkey)""".replace("k AS ncbi_number_scaffolds", "k0 AS ncbi_number_scaffolds"),
)
def assembly_stats(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stats = F.struct(
        (k % 30).alias("totalNumberOfChromosomes"), F.concat(k, F.lit(".0")).alias("numberOfScaffolds"), F.lit("na").alias("numberOfContigs"), F.concat(F.lit(" "), k % 7).alias("numberOfComponentSequences")
    )
    path = scratch_path(spark, "stats")
    rows = I.table(spark, d, "orders").select(c.alias("c"), k.alias("k"), F.to_json(F.struct(F.concat(F.lit("GCA_"), c).alias("accession"), stats.alias("assemblyStats"))).alias("value"))
    rows.repartition("c").sortWithinPartitions("c", "k").select("value").write.text(path)
    return TB.read_assembly_stats(spark, path)


@query("src09_ortholog_links", "SELECT 'odb' || p_partkey AS odb12_id, p_name AS name, p_brand AS orthodb FROM part WHERE p_partkey % 5 <> 0")
def ortholog_links(spark, d):
    path = scratch_path(spark, "links")
    k = F.col("p_partkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("odb"), k, F.lit("\tx"))).otherwise(F.concat_ws("\t", F.concat(F.lit("odb"), k), "p_name", "p_brand", F.lit("more")))
    I.table(spark, d, "part").select(line.alias("value")).write.text(path)
    return TB.read_ortholog_links(spark, path)


@query("src10_id_list", "SELECT DISTINCT 'GCA_' || o_custkey AS id FROM orders WHERE o_orderkey % 3 <> 0")
def id_list(spark, d):
    path = scratch_path(spark, "ids")
    k = F.col("o_orderkey")
    line = F.when(k % 6 == 0, "").when(k % 3 == 0, F.concat(F.lit(" # "), k)).otherwise(F.concat(F.lit(" GCA_"), "o_custkey", F.lit(" note")))
    I.table(spark, d, "orders").select(line.alias("value")).write.text(path)
    return TB.read_id_list(spark, path, first_word=True)


@query("src11_gene_row", "SELECT 'g' || c_custkey AS gene FROM customer")
def gene_row(spark, d):
    path = scratch_path(spark, "genes")
    genes = F.array_join(F.collect_list(F.concat(F.lit(" g"), "c_custkey")), ",")
    I.table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 1000)).agg(genes.alias("value")).select("value").write.text(path)
    return TB.read_gene_row(spark, path)


def gc_trees(spark, d):
    s = F.col("l_suppkey")
    tip = F.concat(F.lit("Genus"), s % 9, F.lit("_Sp"), s, F.lit(" "), s % 50, F.lit(".25:0.1"))
    tips = F.array_sort(F.collect_set(F.struct(s, tip.alias("t"))))
    joined = F.array_join(F.transform(tips, lambda x: x["t"]), ",")
    return I.table(spark, d, "lineitem").groupBy(F.concat(F.lit("og"), "l_partkey").alias("ortholog")).agg(
        F.concat(F.lit("(("), joined, F.lit(")41.25:0.3,(x:0.2,y:0.4)39.5:0.7);")).alias("text")
    )


@query(
    "src12_gc_trees",
    """WITH t AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT l_partkey, count(*) AS n FROM t GROUP BY l_partkey)
  SELECT 'og' || l_partkey AS ortholog, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) - 1 AS pos, 'genus' || (l_suppkey % 9) || '_sp' || l_suppkey AS node, CAST(l_suppkey % 50 + 0.25 AS DOUBLE) AS gc FROM t
  UNION ALL SELECT 'og' || l_partkey, n, 'node_78', 41.25 FROM n UNION ALL SELECT 'og' || l_partkey, n + 1, 'node_79', 39.5 FROM n""",
)
def parse_gc_trees(spark, d):
    return TT.parse_gc_trees(gc_trees(spark, d), 77)


def likelihoods(spark, d):
    k = F.col("p_partkey")
    value = F.when(k % 2 == 0, F.concat(F.lit("0."), k % 90 + 10)).otherwise(F.concat(k % 60 + 2, F.lit(".5")))
    text = F.concat(F.lit("Log 5\n. Ancestral frequencies\n  Ancestral GC "), k, F.lit(" : "), value, F.lit("\nAncestral 9.9\n"))
    return I.table(spark, d, "part").select(F.concat(F.lit("og"), k).alias("ortholog"), text.alias("text"))


_LK = "lk AS (SELECT 'og' || p_partkey AS ortholog, CASE WHEN p_partkey % 2 = 0 THEN CAST('0.' || (p_partkey % 90 + 10) AS DOUBLE) * 100 ELSE CAST((p_partkey % 60 + 2) || '.5' AS DOUBLE) END AS gc FROM part)"


@query("src13_ancestral_gc", f"WITH {_LK} SELECT ortholog, round(gc, 6) AS gc FROM lk")
def ancestral(spark, d):
    return rounded(TT.parse_ancestral_gc(likelihoods(spark, d)))


def _named(spark, d):
    trees = gc_trees(spark, d).select(F.concat("ortholog", F.lit(".tree")).alias("name"), "text")
    part = F.substring("ortholog", 3, 20).cast("bigint")
    lks = likelihoods(spark, d).where(part % 7 != 0).select(F.concat("ortholog", F.lit(".lk")).alias("name"), "text")
    return trees, lks.unionByName(trees.select(F.concat(F.lit("x"), "name").alias("name"), "text"))


@query("src14_pair_files", "SELECT 'og' || p_partkey AS ortholog FROM part WHERE p_partkey % 7 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def pair_files(spark, d):
    return TT.pair_ortholog_files(*_named(spark, d), ".tree", ".lk").select("ortholog")


@query(
    "src14_unpaired",
    """SELECT 'og' || p_partkey AS ortholog, CASE WHEN p_partkey % 7 = 0 THEN 'likelihood' ELSE 'tree' END AS missing FROM part WHERE (p_partkey % 7 = 0) = (p_partkey IN (SELECT l_partkey FROM lineitem)) """,
)
def unpaired(spark, d):
    trees, lks = _named(spark, d)
    left = trees.select(F.regexp_replace("name", r"\.tree$", "").alias("ortholog"))
    right = lks.where(F.col("name").endswith(".lk")).select(F.regexp_replace("name", r"\.lk$", "").alias("ortholog"))
    return TT.unpaired_orthologs(left, right)


@query("src15_node_edges_long", f"WITH {I.EDGES_SQL} SELECT * FROM edges")
def edges_long(spark, d):
    edges = I.edges(spark, d)
    spaced = F.when(F.col("child").startswith("node_"), F.translate("child", "_", " ")).otherwise(F.upper("child"))
    rows = edges.select(spaced.alias("Daughter_Node"), F.when(F.col("parent") == "ancestral", " ROOT").otherwise(F.regexp_replace("parent", "node_", "")).alias("Parent ID"))
    return TT.node_edges(rows.unionByName(rows))


@query("src15_node_edges_wide", f"WITH {I.EDGES_SQL} SELECT * FROM edges")
def edges_wide_in(spark, d):
    return TT.wide_edges(SK.edges_wide(I.edges(spark, d)))


@query(
    "src16_compout",
    """SELECT n_regionkey::VARCHAR AS tree_id, 'node_' || (n_nationkey + 200) AS child, CASE WHEN n_nationkey % 3 = 0 THEN 'ancestral' ELSE 'node_' || (n_nationkey + 199) END AS parent FROM nation""",
)
def compout(spark, d):
    k = F.col("n_nationkey")
    line = F.concat(F.lit(">Node "), k + 200, F.lit(", son of Node "), F.when(k % 3 == 0, F.lit(43)).otherwise(k + 199), F.lit(" by branch of length 1e-3"))
    nation = I.table(spark, d, "nation")
    lines = nation.select(F.col("n_regionkey").cast("string").alias("tree_id"), line.alias("value"))
    roots = I.table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("tree_id"), F.explode(F.array(F.lit(">Node 43, son of Node 43 by branch of length 0.1"), F.lit("other"))).alias("value"))
    return TT.parse_compout(lines.unionByName(roots))


BASE_URL = "http://www.example.org/list/index.php"


def _page_text_sql(e: str) -> str:
    out = f"regexp_replace({e}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]+>', ' ', 'g')"
    for reference, char in PG.REFERENCES.items():
        out = f"replace({out}, '{reference}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '[\\s\u00a0]+', ' ', 'g'))"


@query(
    "src17_links",
    f"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"[^"]*"[^>]*>.*?</a\\s*>')) AS a, unnest(range(0, len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"[^"]*"[^>]*>.*?</a\\s*>')))) AS pos FROM pages),
  r AS (SELECT page_id, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, {_page_text_sql("regexp_extract(a, '(?is)^<a[^>]*>(.*)</a', 1)")} AS t FROM m)
  SELECT CASE WHEN href LIKE '/%' THEN 'http://www.example.org' || href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE 'http://www.example.org/list/' || href END AS url,
    first(page_id ORDER BY page_id, pos) AS page_id, first(t ORDER BY page_id, pos) AS link_text FROM r WHERE contains(href, 'e') GROUP BY url""",
)
def links(spark, d):
    return PG.extract_links(spread(I.table(spark, d, "pages").select("page_id", "html")), "e", BASE_URL)


def table_pages(spark, d):
    """Pages with a table added: the text's words by threes, some cells empty."""
    k = F.col("page_id")
    row = F.concat(F.lit("<tr class='r'><th>Id &amp; "), k, F.lit("</th><td> </td><td><b>u</b>rl\n"), "url", F.lit("</td></tr><tr><td></td></tr>"))
    table = F.concat(F.lit('<table id="a">'), row, row, F.lit("</table><table><tr><td>C-value: "), k % 9, F.lit(".25</td><td>1C 2.5 pg, 3 PG</td></tr></table>"))
    return spread(I.table(spark, d, "pages").select("page_id", "url", "html")).select(
        "page_id", F.concat("html", table).alias("html"), F.when(k % 3 == 0, "Details").when(k % 3 == 1, F.concat(F.lit("Genus sp"), k)).otherwise("").alias("link_text")
    )


@query(
    "src18_table_rows",
    """SELECT page_id, CAST(1 AS BIGINT) AS table_index, unnest([1, 3])::BIGINT AS row_index, 'Id & ' || page_id || ' | u rl ' || url AS cells_joined FROM pages
  UNION ALL SELECT page_id, 2, 1, 'C-value: ' || (page_id % 9) || '.25 | 1C 2.5 pg, 3 PG' FROM pages""",
)
def table_rows(spark, d):
    return PG.extract_table_rows(table_pages(spark, d))


_C = "list_transform(regexp_extract_all(t, '{p}', 1), lambda x: x)"


@query(
    "src19_c_values",
    f"""WITH p AS (SELECT page_id, {_page_text_sql("html || '<table>C-value: ' || (page_id % 9) || '.25</td><td>1C 2.5 pg, 3 PG</table>'")} AS t, {_page_text_sql("regexp_extract(html, '(?is)<h[123][^>]*>(.*?)</h[123]', 1)")} AS h FROM pages),
  q AS (SELECT page_id, h, list_concat(list_concat(regexp_extract_all(t, '(?i)C[-\\s]?value[^0-9]{{0,20}}([0-9]+(?:\\.[0-9]+)?)', 1), regexp_extract_all(t, '(?i)\\b1C[^0-9]{{0,20}}([0-9]+(?:\\.[0-9]+)?)', 1)), regexp_extract_all(t, '(?i)\\b([0-9]+(?:\\.[0-9]+)?)\\s*pg\\b', 1)) AS l FROM p),
  u AS (SELECT page_id, h, list_filter(l, lambda x, i: list_position(l, x) = i) AS v FROM q)
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Details' WHEN 1 THEN 'Genus sp' || page_id ELSE '' END AS link_text, CASE WHEN page_id % 3 = 1 THEN 'Genus sp' || page_id ELSE h END AS species_name,
    array_to_string(v, ';') AS c_values_pg_detected, CAST(len(v) AS BIGINT) AS n_c_values_detected FROM u""",
)
def c_values(spark, d):
    return PG.extract_c_values(table_pages(spark, d)).drop("species_key")


@query(
    "src20_distances",
    """SELECT 'node_' || o_custkey AS child, 'ancestral' AS parent, o_totalprice AS dij FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""",
)
def distance_table(spark, d):
    k = F.col("o_orderkey")
    rows = I.table(spark, d, "orders").select(
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Node "), "o_custkey")).alias("Daughter"), F.lit("Root").alias("parent_node"), F.when(k % 7 != 0, F.col("o_totalprice").cast("string")).otherwise("NA").alias("D_ij")
    )
    return TT.distances(rows)


def _dij_rows(spark, d):
    return I.table(spark, d, "supplier").select(F.concat(F.lit("node_"), "s_suppkey").alias("child"), F.concat(F.lit("node_"), "s_nationkey").alias("parent"), "s_acctbal")


@query("src20_nested_distances", "SELECT 'node_' || s_suppkey AS child, 'node_' || s_nationkey AS parent, s_acctbal AS dij FROM supplier")
def nested_in(spark, d):
    path = scratch_path(spark, "nested")
    SK.write_nested_json(_dij_rows(spark, d), path, "child", "parent", "s_acctbal")
    return TT.nested_distances(spark.read.text(path))


@query("snk05_nested_json", """SELECT 'node_' || s_suppkey AS child, '{"node_' || s_suppkey || '":{"node_' || s_nationkey || '":' || CASE WHEN s_acctbal = floor(s_acctbal) THEN CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(s_acctbal AS VARCHAR) END || '}}' AS value FROM supplier""")
def nested_out(spark, d):
    return SK.nested(_dij_rows(spark, d), "child", "parent", "s_acctbal")


@query("snk04_write_fasta", f"WITH {I.ALN_SQL} SELECT sequence_id, count(*) AS n, sum(length(seq))::BIGINT AS n_bases FROM aln GROUP BY ALL")
def write_fasta(spark, d):
    path = scratch_path(spark, "fasta")
    aln = I.alignments(spark, d).withColumn("taxon", F.col("sequence_id"))
    SK.write_fasta(aln.withColumn("name", F.concat_ws(".", "alignment", "taxon")), path, "sequence_id", "name")
    back = FA.read_alignments(spark, path + "/*/*.txt", BLOCK * 10)
    taxon = F.substring_index("sequence_id", ".", -1).alias("sequence_id")
    return back.select(taxon, "seq").groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("n_bases"))


@query(
    "snk06_phylip_lines",
    f"""WITH {I.ALN_SQL} SELECT alignment, '' AS name, ' ' || count(*) || ' ' || max(length(seq)) AS value FROM aln GROUP BY alignment UNION ALL SELECT alignment, sequence_id, sequence_id || ' ' || seq FROM aln""",
)
def phylip(spark, d):
    return SK.phylip_lines(I.alignments(spark, d)).withColumnRenamed("_name", "name")


@query("snk06_write_phylip", "WITH x AS (SELECT 'src_' || lang AS alignment, count(*) AS n FROM documents GROUP BY lang) SELECT alignment, n + 1 AS n_lines, ' ' || n || ' 5' AS first_line FROM x")
def write_phylip(spark, d):
    path = scratch_path(spark, "phylip")
    docs = I.table(spark, d, "documents").select(F.concat(F.lit("src_"), "lang").alias("alignment"), F.concat(F.lit("d"), "doc_id").alias("sequence_id"), F.lpad(F.hex("doc_id"), 5, "0").alias("seq"))
    SK.write_phylip(docs, path)
    folder = F.regexp_extract("file", "alignment=([^/]*)/", 1)
    lines = TB.read_lines(spark, path).withColumn("alignment", folder)
    return lines.groupBy("alignment").agg(F.count(F.lit(1)).alias("n_lines"), F.min(F.struct("file", "line_no", "value")).getField("value").alias("first_line"))


@query("snk07_append_log", "SELECT event_id, event_type AS stage, user_id FROM events UNION ALL SELECT event_id + 1000000000, 'unpack', user_id FROM events WHERE event_type = 'error'")
def append_log(spark, d):
    path = scratch_path(spark, "log")
    events = I.table(spark, d, "events").select("event_id", F.col("event_type").alias("stage"), "user_id")
    SK.append_log(events, path)
    SK.append_log(events.where("stage = 'error'").select((F.col("event_id") + 1000000000).alias("event_id"), F.lit("unpack").alias("stage"), "user_id"), path)
    return spark.read.schema(events.schema).json(path)


@query("snk08_edges_wide", f"WITH {I.EDGES_SQL} SELECT (SELECT string_agg(child, ',' ORDER BY child) FROM edges) AS children, (SELECT string_agg(parent, ',' ORDER BY child) FROM edges) AS parents")
def edges_wide(spark, d):
    path = scratch_path(spark, "edges")
    SK.write_edges_wide(I.edges(spark, d), path)
    lines = TB.read_lines(spark, path).withColumn("line", F.regexp_extract("file", "line=([01])/", 1))
    whole = lambda i: F.array_join(F.array_sort(F.collect_list(F.when(F.col("line") == i, F.struct("file", "line_no", "value"))))["value"], ",")
    return lines.agg(whole("0").alias("children"), whole("1").alias("parents"))


def _load_sides(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    target = I.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("genome_pk"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 4 == 0).alias("is_current"), F.lit("old").alias("origin"))
    new = I.table(spark, d, "orders").select(
        c.alias("genome_pk"), F.when(k % 9 == 0, " NaN ").otherwise(F.col("o_orderstatus")).alias("name"), F.when(k % 2 == 0, "yes").otherwise("Failed").alias("is_current"), F.lit("x").alias("unknown"), k.alias("row_idx")
    )
    return target, new


_LOAD = """t AS (SELECT c_custkey AS genome_pk, c_mktsegment AS name, c_custkey % 4 = 0 AS is_current, 'old' AS origin FROM customer WHERE c_custkey % 2 = 0),
  n AS (SELECT o_custkey AS genome_pk, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS name, o_orderkey % 2 = 0 AS is_current, CAST(NULL AS VARCHAR) AS origin, o_orderkey AS k FROM orders)"""


@query("snk03_load_ignore", f"WITH {_LOAD} SELECT * FROM t UNION ALL SELECT * EXCLUDE (k) FROM n WHERE genome_pk NOT IN (SELECT genome_pk FROM t) QUALIFY row_number() OVER (PARTITION BY genome_pk ORDER BY k) = 1")
def load_ignore(spark, d):
    return SK.load_table(*_load_sides(spark, d), ["genome_pk"], "ignore", "row_idx")


@query("snk03_load_replace", f"WITH {_LOAD} SELECT * FROM t WHERE genome_pk NOT IN (SELECT genome_pk FROM n) UNION ALL (SELECT * EXCLUDE (k) FROM n QUALIFY row_number() OVER (PARTITION BY genome_pk ORDER BY k DESC) = 1)")
def load_replace(spark, d):
    return SK.load_table(*_load_sides(spark, d), ["genome_pk"], "replace", "row_idx")


@query("snk03_load_insert", f"WITH {_LOAD} SELECT * FROM t UNION ALL SELECT genome_pk + 10000000 * (k + 1), name, is_current, origin FROM n")
def load_insert(spark, d):
    target, new = _load_sides(spark, d)
    return SK.load_table(target, new.withColumn("genome_pk", F.col("genome_pk") + 10000000 * (F.col("row_idx") + 1)), ["genome_pk"], "insert")


@query("snk03_load_report", f"WITH {_LOAD} SELECT 'ignore' AS mode, count(*) AS n_source_rows, count(*) FILTER (genome_pk IN (SELECT genome_pk FROM t)) AS n_key_clashes FROM n")
def load_report(spark, d):
    return SK.load_report(*_load_sides(spark, d), ["genome_pk"], "ignore")


@query("st01_ingest_stream", "SELECT 'GCA_' || o_custkey || '.1' AS accession, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders) GROUP BY o_custkey")
def ingest(spark, d):
    """Two drops of summary files; the second repeats part of the first."""
    from baseloom.streaming.ingest import ingest_stream, read_catalog

    folder, catalog, checkpoint = (scratch_path(spark, n) for n in ("drop", "catalog", "progress"))
    rows = _summaries(spark, d).where("value <> ''")
    rows.where("k % 2 = 0").select("value").write.mode("append").text(folder)
    ingest_stream(spark, folder, catalog, checkpoint).awaitTermination()
    rows.where("k % 3 < 2").select("value").write.mode("append").text(folder)
    ingest_stream(spark, folder, catalog, checkpoint).awaitTermination()
    rows.where("k % 2 = 1").select("value").write.mode("append").text(folder)
    ingest_stream(spark, folder, catalog, checkpoint).awaitTermination()
    return read_catalog(spark, catalog).groupBy("accession").agg(F.count(F.lit(1)).alias("n"))


