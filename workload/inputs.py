"""The given tables in genomic shape: once as DataFrames, once as SQL.

Whole tables and whole texts are used. Prose letters become bases; order
lines become exons; customers, suppliers and parts become trait sources;
regions, nations and suppliers become a tree.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from baseloom.functions.kernels import translated
from baseloom.session import spread

# Chunks of the window queries and of the interval queries.
CHUNK_BP = 6000
SLICE_BP = 240
SIZES = [600, 300]
LETTERS, BASES = "BDEFHIJKLMOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTN"
N_GENOMES = 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


_BASE_OF = {**{c: c for c in "ACGTN"}, **dict(zip(LETTERS, BASES))}
_BYTES = bytes(ord(_BASE_OF[chr(b).upper()]) if chr(b).upper() in _BASE_OF else b for b in range(256))
_OTHER = bytes(b for b in range(256) if not (chr(b).isascii() and chr(b).isalpha()))


@F.arrow_udf(StringType())
def dna_of(text: pa.Array) -> pa.Array:
    """Letters to bases by a byte table; all other bytes are dropped."""
    return translated(text, _BYTES, _OTHER)


def dna(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", dna_of(F.col("text")).alias("bases")
    )


DNA_SQL = f"""dna AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')),
  '{LETTERS}', '{BASES}') AS bases FROM documents)"""


def seqs(spark, d) -> DataFrame:
    """Sequences of 20 genomes, one per document."""
    return dna(spark, d).select(
        (F.col("doc_id") % N_GENOMES + 1).alias("genome_pk"),
        (F.col("doc_id") + 1).alias("sequence_pk"),
        F.concat(F.lit("seq_"), "doc_id").alias("sequence_id"),
        F.element_at(
            F.array(*[F.lit(t) for t in ("chromosome", "chromosome", "scaffold", "mitochondrion")]),
            (F.col("doc_id") % 4 + 1).cast("int"),
        ).alias("sequence_type"),
        F.length("bases").cast("bigint").alias("sequence_length"),
        "bases",
    )


SEQS_SQL = (
    DNA_SQL
    + f""", seqs AS (SELECT doc_id % {N_GENOMES} + 1 AS genome_pk, doc_id + 1 AS sequence_pk,
  'seq_' || doc_id AS sequence_id,
  ['chromosome', 'chromosome', 'scaffold', 'mitochondrion'][doc_id % 4 + 1] AS sequence_type,
  CAST(length(bases) AS BIGINT) AS sequence_length, bases FROM dna)"""
)


def chunks(spark, d, chunk_bp: int = CHUNK_BP) -> DataFrame:
    from baseloom.operators.windows import chunk_sequences

    return chunk_sequences(seqs(spark, d), chunk_bp)


_STORES: dict[tuple, object] = {}


def chunk_store(spark, d, chunk_bp: int = SLICE_BP):
    """The chunks as a store, written once per session and folder: slicing queries share it."""
    from baseloom.sources.chunk_store import is_whole, write_chunk_store

    key = (spark.sparkContext.applicationId, d, chunk_bp)
    if key not in _STORES or not is_whole(spark, _STORES[key]):
        _STORES[key] = write_chunk_store(chunks(spark, d, chunk_bp))
    return _STORES[key]


def genomes(spark, d) -> DataFrame:
    """Genomes that occur, and one without sequences."""
    found = seqs(spark, d).select("genome_pk").distinct()
    return found.unionByName(spark.range(1).select(F.lit(N_GENOMES + 1).cast("bigint").alias("genome_pk"))).select(
        "genome_pk",
        F.concat(F.lit("GCF_"), F.lpad(F.col("genome_pk").cast("string"), 9, "0"), F.lit(".1")).alias("accession_id"),
        F.when(F.col("genome_pk") % 7 != 0, F.col("genome_pk")).alias("species_pk"),
    )


GENOMES_SQL = f"""genomes AS (SELECT genome_pk, 'GCF_' || lpad(CAST(genome_pk AS VARCHAR), 9, '0') || '.1' AS accession_id,
  CASE WHEN genome_pk % 7 <> 0 THEN genome_pk END AS species_pk
  FROM (SELECT DISTINCT genome_pk FROM seqs UNION ALL SELECT {N_GENOMES + 1}))"""

CDS_BP = 30


def cds(spark, d) -> DataFrame:
    """Each document's sequence cut into genes of 30 bases; the last is shorter."""
    pieces = F.regexp_extract_all(F.col("bases"), F.lit(f".{{1,{CDS_BP}}}"), F.lit(0))
    return dna(spark, d).select("doc_id", F.posexplode(pieces).alias("piece", "seq")).select(
        "doc_id",
        F.concat(F.lit("GCA_"), F.lpad((F.col("doc_id") % 50).cast("string"), 9, "0"), F.lit(".1")).alias("accession"),
        F.concat_ws("_", F.lit("gene"), "doc_id", "piece").alias("gene"),
        F.col("piece").cast("bigint").alias("piece"),
        "seq",
    )


CDS_SQL = (
    DNA_SQL
    + f""", cds AS (SELECT doc_id, 'GCA_' || lpad(CAST(doc_id % 50 AS VARCHAR), 9, '0') || '.1' AS accession,
  'gene_' || doc_id || '_' || piece AS gene, piece, substring(bases, piece * {CDS_BP} + 1, {CDS_BP}) AS seq
  FROM (SELECT doc_id, bases, unnest(range(0, (length(bases) + {CDS_BP - 1}) // {CDS_BP})) AS piece FROM dna))"""
)


def exons(spark, d) -> DataFrame:
    """One exon per order line number, on the sequence the order falls on."""
    n_docs = table(spark, d, "documents").agg(F.count(F.lit(1))).scalar()
    start = F.col("l_linenumber") * 60 + F.col("l_suppkey") % 20
    return (
        table(spark, d, "lineitem")
        .select(
            F.col("l_orderkey").alias("gene_no"),
            F.col("l_linenumber").cast("bigint").alias("exon_no"),
            start.cast("bigint").alias("start"),
            (start + F.floor("l_quantity") % 50).cast("bigint").alias("end"),
        )
        .groupBy("gene_no", "exon_no")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .withColumn("doc_id", F.col("gene_no") % n_docs)
    )


EXONS_SQL = """exons AS (SELECT gene_no, exon_no, min(s) AS "start", max(e) AS "end",
  gene_no % (SELECT count(*) FROM documents) AS doc_id
  FROM (SELECT l_orderkey AS gene_no, CAST(l_linenumber AS BIGINT) AS exon_no,
    CAST(l_linenumber * 60 + l_suppkey % 20 AS BIGINT) AS s,
    CAST(l_linenumber * 60 + l_suppkey % 20 + CAST(floor(l_quantity) AS BIGINT) % 50 AS BIGINT) AS e FROM lineitem)
  GROUP BY gene_no, exon_no)"""


def far_exons(spark, d) -> DataFrame:
    """Exons over the whole sequence: a gene begins anywhere in its first quarter, its exons lie tenths of the length apart."""
    at = dna(spark, d).select("doc_id", F.length("bases").cast("bigint").alias("n"))
    near = (
        table(spark, d, "lineitem")
        .select(F.col("l_orderkey").alias("gene_no"), F.col("l_linenumber").cast("bigint").alias("exon_no"), "l_suppkey", "l_quantity")
        .withColumn("doc_id", F.col("gene_no") % table(spark, d, "documents").agg(F.count(F.lit(1))).scalar())
    )
    start = (F.col("gene_no") * 7919) % F.expr("n DIV 4 + 1") + F.col("exon_no") * F.expr("60 + n DIV 10") + F.col("l_suppkey") % 20
    return (
        near.join(at, "doc_id")
        .select("gene_no", "exon_no", "doc_id", start.alias("start"), (start + F.floor("l_quantity") % 50).cast("bigint").alias("end"))
        .groupBy("gene_no", "exon_no", "doc_id")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )


FAR_EXONS_SQL = """exons AS (SELECT gene_no, exon_no, min(s) AS "start", max(s + q) AS "end", doc_id
  FROM (SELECT l_orderkey AS gene_no, CAST(l_linenumber AS BIGINT) AS exon_no, doc_id, CAST(floor(l_quantity) AS BIGINT) % 50 AS q,
    l_orderkey * 7919 % (n // 4 + 1) + l_linenumber * (60 + n // 10) + l_suppkey % 20 AS s
    FROM lineitem JOIN (SELECT doc_id, CAST(length(bases) AS BIGINT) AS n FROM dna) ON doc_id = l_orderkey % (SELECT count(*) FROM documents))
  GROUP BY gene_no, exon_no, doc_id)"""


def far_models(spark, d) -> DataFrame:
    return models(spark, d, far_exons)


def models(spark, d, exons_of=exons) -> DataFrame:
    """Gene models with their exons; some are duplicated or fragmented."""
    number = F.col("gene_no")
    return (
        exons_of(spark, d)
        .groupBy("gene_no", "doc_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
        .select(
            F.concat(F.lit("g"), number).alias("gene"),
            (F.col("doc_id") % N_GENOMES + 1).alias("genome_pk"),
            F.concat(F.lit("seq_"), "doc_id").alias("sequence_id"),
            F.when(number % 10 == 0, "Duplicated").when(number % 10 == 1, "Fragmented").otherwise("Single").alias("status"),
            F.when(number % 2 == 0, "+").otherwise("-").alias("strand"),
            "start",
            "end",
            "exons",
        )
    )


MODELS_SQL = (
    EXONS_SQL
    + f""", models AS (SELECT 'g' || gene_no AS gene, gene_no, doc_id, doc_id % {N_GENOMES} + 1 AS genome_pk,
  'seq_' || doc_id AS sequence_id,
  CASE gene_no % 10 WHEN 0 THEN 'Duplicated' WHEN 1 THEN 'Fragmented' ELSE 'Single' END AS status,
  CASE gene_no % 2 WHEN 0 THEN '+' ELSE '-' END AS strand,
  min("start") AS "start", max("end") AS "end" FROM exons GROUP BY gene_no, doc_id)"""
)

ALN_BP = 60
ALN_DOCS = 3


def alignments(spark, d) -> DataFrame:
    """Three documents side by side, in blocks of 60 sites; short ends are gaps."""
    pieces = F.regexp_extract_all(F.col("bases"), F.lit(f".{{1,{ALN_BP}}}"), F.lit(0))
    site = F.replace(F.rpad("piece", ALN_BP, "-"), F.lit("TTT"), F.lit("TT!"))
    return dna(spark, d).select("doc_id", F.posexplode(pieces).alias("block", "piece")).select(
        F.concat_ws("_", F.lit("aln"), F.floor(F.col("doc_id") / ALN_DOCS).cast("bigint"), "block").alias("alignment"),
        F.concat(F.lit("taxon"), F.col("doc_id") % 60).alias("sequence_id"),
        site.alias("seq"),
    )


ALN_SQL = (
    DNA_SQL
    + f""", aln AS (SELECT 'aln_' || (doc_id // {ALN_DOCS}) || '_' || block AS alignment,
  'taxon' || (doc_id % 60) AS sequence_id,
  replace(rpad(substring(bases, block * {ALN_BP} + 1, {ALN_BP}), {ALN_BP}, '-'), 'TTT', 'TT!') AS seq
  FROM (SELECT doc_id, bases, unnest(range(0, (length(bases) + {ALN_BP - 1}) // {ALN_BP})) AS block FROM dna))"""
)


def assemblies(spark, d) -> DataFrame:
    """Assembly records from orders: several versions and sources per species."""
    number = F.col("o_custkey")
    accession = F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, "GCF_").otherwise("GCA_"),
        F.lpad(number.cast("string"), 9, "0"),
        F.lit("."),
        F.col("o_orderkey") % 4,
    )
    return (
        table(spark, d, "orders")
        .select(accession.alias("accession"), number.alias("n"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
        .groupBy("accession")
        .agg(F.min(F.struct("k", "n", "p")).alias("f"))
        .select(
            "accession",
            F.concat(F.lit("Genus"), F.col("f.n") % 60, F.lit(" species"), F.col("f.n") % 300).alias("organism_name"),
            F.when(F.col("f.n") % 41 == 0, "").otherwise(F.concat(F.lit("Genus"), F.col("f.n") % 60, F.lit("_species"), F.col("f.n") % 300)).alias("species_key"),
            F.when(F.col("f.p") == "1-URGENT", "Chromosome").when(F.col("f.p") == "2-HIGH", "Complete Genome").otherwise("Scaffold").alias("assembly_level"),
            F.col("f.k").alias("row_idx"),
        )
    )


ASM_SQL = """assemblies AS (SELECT accession, 'Genus' || (n % 60) || ' species' || (n % 300) AS organism_name,
  CASE WHEN n % 41 = 0 THEN '' ELSE 'Genus' || (n % 60) || '_species' || (n % 300) END AS species_key,
  CASE p WHEN '1-URGENT' THEN 'Chromosome' WHEN '2-HIGH' THEN 'Complete Genome' ELSE 'Scaffold' END AS assembly_level,
  k AS row_idx
  FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'GCF_' ELSE 'GCA_' END || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
      || '.' || (o_orderkey % 4) AS accession, o_custkey AS n, o_orderkey AS k, o_orderpriority AS p FROM orders
    QUALIFY row_number() OVER (PARTITION BY accession ORDER BY o_orderkey) = 1))"""


def edges(spark, d) -> DataFrame:
    """Tree: regions below the root, nations below regions, suppliers as tips."""
    region = table(spark, d, "region").select(
        F.concat(F.lit("node_"), F.col("r_regionkey") + 100).alias("child"), F.lit("ancestral").alias("parent")
    )
    nation = table(spark, d, "nation").select(
        F.concat(F.lit("node_"), F.col("n_nationkey") + 200).alias("child"),
        F.concat(F.lit("node_"), F.col("n_regionkey") + 100).alias("parent"),
    )
    tips = table(spark, d, "supplier").select(
        F.concat(F.lit("genus"), F.col("s_suppkey") % 9, F.lit("_sp"), F.col("s_suppkey")).alias("child"),
        F.concat(F.lit("node_"), F.col("s_nationkey") + 200).alias("parent"),
    )
    return region.unionByName(nation).unionByName(tips)


EDGES_SQL = """edges AS (SELECT 'node_' || (r_regionkey + 100) AS child, 'ancestral' AS parent FROM region
  UNION ALL SELECT 'node_' || (n_nationkey + 200), 'node_' || (n_regionkey + 100) FROM nation
  UNION ALL SELECT 'genus' || (s_suppkey % 9) || '_sp' || s_suppkey, 'node_' || (s_nationkey + 200) FROM supplier)"""


def node_gc(spark, d) -> DataFrame:
    """GC per ortholog (part) and tree node (supplier, its nation, its region, all).

    Lines are summed per part and supplier first; then each part's sums move once, and its nodes are formed where they lie.
    """
    nation = table(spark, d, "nation")
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    nodes = F.array(
        F.concat(F.lit("genus"), F.col("s_suppkey") % 9, F.lit("_sp"), F.col("s_suppkey")),
        F.concat(F.lit("node_"), F.col("s_nationkey") + 200),
        F.concat(F.lit("node_"), F.col("n_regionkey") + 100),
        F.lit("ancestral"),
    )
    sums = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("total"), F.count(F.lit(1)).alias("n")
    )
    return (
        sums.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_partkey", "s_suppkey", "s_nationkey", "n_regionkey", "total", "n")
        .repartition("l_partkey")
        .select("l_partkey", F.explode(nodes).alias("node"), "total", "n")
        .groupBy("l_partkey", "node")
        .agg((F.sum("total") / F.sum("n")).alias("gc"))
        .select(F.concat(F.lit("og"), "l_partkey").alias("ortholog"), "node", "gc")
    )


NODE_GC_SQL = (
    EDGES_SQL
    + """, node_gc AS (SELECT ortholog, node, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS gc
  FROM (SELECT 'og' || l_partkey AS ortholog, l_discount, unnest(['genus' || (s_suppkey % 9) || '_sp' || s_suppkey,
      'node_' || (s_nationkey + 200), 'node_' || (n_regionkey + 100), 'ancestral']) AS node
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
  GROUP BY ortholog, node)"""
)


def raw_names(spark, d) -> DataFrame:
    """Species names as sources write them: qualifiers, brackets, hybrids, case."""
    k = F.col("c_custkey")
    genus = F.concat(F.lit("Genus"), F.translate((k % 97).cast("string"), "0123456789", "abcdefghij"))
    species = F.concat(F.lit("spec"), F.translate((k % 131).cast("string"), "0123456789", "klmnopqrst"))
    name = (
        F.when(k % 11 == 0, F.concat(genus, F.lit(" cf. "), species))
        .when(k % 11 == 1, F.concat(genus, F.lit("_"), species, F.lit("_sub")))
        .when(k % 11 == 2, F.concat(F.lit("  "), genus, F.lit("  "), species, F.lit(" (L. 1758)")))
        .when(k % 11 == 3, F.concat(genus, F.lit(" x "), species))
        .when(k % 11 == 4, F.concat(F.upper(genus), F.lit(" sp. "), species, F.lit("-minor 2")))
        .when(k % 11 == 5, F.concat(genus, F.lit(" ["), species, F.lit("]")))
        .when(k % 11 == 6, F.lit("nan"))
        .when(k % 11 == 7, F.lit(" "))
        .when(k % 11 == 8, genus)
        .when(k % 11 == 9, F.concat(F.lit("'"), genus, F.lit("."), species, F.lit("'")))
        .otherwise(F.concat(genus, F.lit(" "), species))
    )
    return table(spark, d, "customer").select(
        k.alias("row_idx"),
        name.alias("raw_name"),
        F.col("c_nationkey").alias("nation"),
        F.when(k % 5 != 0, F.col("c_acctbal")).alias("value"),
        F.when(k % 13 == 0, "n/a").when(k % 13 == 1, "inf").otherwise(F.col("c_acctbal").cast("string")).alias("value_text"),
    )


NAMES_SQL = """names AS (SELECT c_custkey AS row_idx, c_nationkey AS nation,
  CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS value,
  CASE WHEN c_custkey % 13 IN (0, 1) THEN NULL ELSE c_acctbal END AS number,
  CASE c_custkey % 11 WHEN 0 THEN g || ' cf. ' || s WHEN 1 THEN g || '_' || s || '_sub'
    WHEN 2 THEN '  ' || g || '  ' || s || ' (L. 1758)' WHEN 3 THEN g || ' x ' || s
    WHEN 4 THEN upper(g) || ' sp. ' || s || '-minor 2' WHEN 5 THEN g || ' [' || s || ']' WHEN 6 THEN 'nan'
    WHEN 7 THEN ' ' WHEN 8 THEN g WHEN 9 THEN '''' || g || '.' || s || '''' ELSE g || ' ' || s END AS raw_name
  FROM (SELECT *, 'Genus' || translate(CAST(c_custkey % 97 AS VARCHAR), '0123456789', 'abcdefghij') AS g,
    'spec' || translate(CAST(c_custkey % 131 AS VARCHAR), '0123456789', 'klmnopqrst') AS s FROM customer))"""
# The taxon key of a raw name, written again for the other engine.
TAXON_SQL = """coalesce(nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(
  regexp_replace(replace({0}, '_', ' '), '\\([^)]*\\)', ' ', 'g'), '[^A-Za-z×\\s.\\-]', ' ', 'g')), '\\s+'),
  lambda t: lower(trim(t, '.'))), lambda t: t NOT IN ('', 'sp', 'spp', 'cf', 'aff', 'nr', 'x', '×'))[1:2], '_'), ''), 'unknown_species')"""
