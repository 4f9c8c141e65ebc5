"""Names, trait sources, audits, joined tables, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from baseloom.functions import cleaning as CL
from baseloom.functions.names import normalize_species
from baseloom.operators import ranking as R
from baseloom.operators import stats as ST
from baseloom.operators import traits as TR
from baseloom.session import spread, stored
from workload import inputs as I
from workload.registry import query, rounded

TAXON = I.TAXON_SQL.format("raw_name")
KEYED = f"keyed AS (SELECT *, {TAXON} AS species_normalized FROM names)"

_TWO = """array_to_string((CASE WHEN contains({0}, '_') THEN list_filter(string_split({0}, '_'), lambda t: t <> '')
  ELSE list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> '') END)[1:2], '_')"""
_TRIM = _TWO.format("trim(raw_name)")
_FULL = "lower(trim(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(trim(raw_name), '\\([^)]*\\)', ' ', 'g'), '-.', '  '), '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '_'))"
_LABEL = "lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(raw_name), '[''\"]', '', 'g'), '\\[.*?\\]|\\(.*?\\)', '', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_'))"
_MODES = {
    "ncbi": "regexp_replace(trim(raw_name), '\\s+', '_', 'g')",
    "binomial": f"coalesce(nullif({_TRIM}, ''), 'unknown_species')",
    "binomial_lower": f"lower(coalesce(nullif({_TRIM}, ''), 'unknown_species'))",
    "full": _FULL,
    "full_key": f"array_to_string(string_split({_FULL}, '_')[1:2], '_')",
    "taxon": TAXON,
    "trait": "CASE WHEN lower(trim(raw_name)) = 'nan' THEN 'unknown_species' ELSE "
    + I.TAXON_SQL.format("regexp_replace(raw_name, '\\[[^\\]]*\\]', ' ', 'g')")
    + " END",
    "label": _LABEL,
    "label_key": f"array_to_string(string_split({_LABEL}, '_')[1:2], '_')",
    "display": f"upper(left(coalesce(nullif({_TRIM}, ''), 'unknown_species'), 1)) || lower(substring(coalesce(nullif({_TRIM}, ''), 'unknown_species'), 2))",
    "shell": """regexp_replace(regexp_replace(lower(CASE WHEN contains(trim(raw_name), '_') THEN trim(raw_name) ELSE
    coalesce(regexp_split_to_array(trim(raw_name), '\\s+')[1], '') || '_' || coalesce(regexp_split_to_array(trim(raw_name), '\\s+')[2], '') END), '[^a-z0-9_]', '', 'g'), '_$', '')""",
}


@query(
    "p03_normalize_species",
    f"WITH {I.NAMES_SQL} SELECT row_idx, {', '.join(f'{e} AS {m}_key' for m, e in _MODES.items())} FROM names",
)
def normalize(spark, d):
    df = I.raw_names(spark, d)
    return df.select("row_idx", *[normalize_species(F.col("raw_name"), m).alias(f"{m}_key") for m in _MODES])


_WORDS = "['NaN', 'none', '', '  NA', 'null', '\\N', '<na>', 'True', 'no', 'pass', '2', ' F ', '1', '-3.7', 'abc', '1e3']"
_WORD_LIST = ["NaN", "none", "", "  NA", "null", "\\N", "<na>", "True", "no", "pass", "2", " F ", "1", "-3.7", "abc", "1e3"]
_W = f"w AS (SELECT event_id, {_WORDS}[event_id % 16 + 1] AS word FROM events)"


def _words(spark, d):
    words = F.array(*[F.lit(w) for w in _WORD_LIST])
    return I.table(spark, d, "events").select("event_id", F.get(words, (F.col("event_id") % 16).cast("int")).alias("word"))


@query(
    "p05_canonical_null",
    f"""WITH {_W} SELECT event_id, CASE WHEN lower(trim(word)) NOT IN ('', 'nan', 'none', 'null', 'na') THEN trim(word) END AS builder,
  CASE WHEN trim(word) NOT IN ('', '\\N', 'NULL', 'null', 'None', 'none', 'NaN', 'nan', 'NA', 'na') THEN trim(word) END AS loader,
  CASE WHEN lower(trim(word)) NOT IN ('', 'na', 'nan', 'none', 'null', '<na>') THEN trim(word) END AS feature FROM w""",
)
def canonical_null(spark, d):
    word = F.col("word")
    return _words(spark, d).select("event_id", *[CL.null_if_blank(word, m).alias(m) for m in ("builder", "loader", "feature")])


@query(
    "p06_canonical_bool",
    f"""WITH {_W}, x AS (SELECT event_id, lower(trim(word)) AS t FROM w) SELECT event_id,
  CASE WHEN t IN ('true', 't', '1', 'yes', 'y') THEN true WHEN t IN ('false', 'f', '0', 'no', 'n') THEN false END AS builder,
  t IN ('true', 't', '1', 'yes', 'y', 'pass', 'passed') AS feature, t IN ('true', '1', 'yes', 'y') AS flag FROM x""",
)
def canonical_bool(spark, d):
    word = F.col("word")
    return _words(spark, d).select("event_id", *[CL.canonical_bool(word, m).alias(m) for m in ("builder", "feature", "flag")])


@query(
    "p06_strict_bool",
    """SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS strict, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def strict_bool(spark, d):
    word = F.when(F.col("l_returnflag") == "A", " PASS").otherwise("failed")
    return (
        I.table(spark, d, "lineitem")
        .select("l_orderkey", "l_linenumber", CL.canonical_bool(word, "strict").alias("strict"))
        .groupBy("l_orderkey", "l_linenumber", "strict")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p23_critical_metric",
    """SELECT event_id, event_id % 5 IN (0, 1) AS is_max, event_id % 5 IN (2, 3) AS is_min FROM events""",
)
def critical(spark, d):
    labels = F.array(*[F.lit(x) for x in ("CT-max", "Critical thermal_Maximum", "ct_min ", "critical thermal min", "lethal max")])
    label = F.get(labels, (F.col("event_id") % 5).cast("int"))
    return I.table(spark, d, "events").select(
        "event_id", CL.is_critical_limit(label, "max").alias("is_max"), CL.is_critical_limit(label, "min").alias("is_min")
    )


_PATHS = """paths AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '/data/genomes/old/a.fna' WHEN 1 THEN '/data/genomes/x/rNatHel.fna.gz'
  WHEN 2 THEN '/data/genomes/x/a_cds_b.fa' WHEN 3 THEN '\\N' WHEN 4 THEN '' WHEN 5 THEN 'x/' || event_id || '.txt' END AS path_to_fna,
  CASE event_id % 3 WHEN 0 THEN '/m/records/y/' || event_id || '.fasta' WHEN 1 THEN 'z.protein.fasta' END AS genome_path FROM events)"""


def _paths(spark, d):
    k = F.col("event_id")
    first = (
        F.when(k % 7 == 0, "/data/genomes/old/a.fna").when(k % 7 == 1, "/data/genomes/x/rNatHel.fna.gz").when(k % 7 == 2, "/data/genomes/x/a_cds_b.fa")
        .when(k % 7 == 3, "\\N").when(k % 7 == 4, "").when(k % 7 == 5, F.concat(F.lit("x/"), k, F.lit(".txt")))
    )
    second = F.when(k % 3 == 0, F.concat(F.lit("/m/records/y/"), k, F.lit(".fasta"))).when(k % 3 == 1, "z.protein.fasta")
    return I.table(spark, d, "events").select("event_id", first.alias("path_to_fna"), second.alias("genome_path"))


@query(
    "p09_choose_fasta_path",
    f"""WITH {_PATHS} SELECT event_id, CASE WHEN event_id % 7 = 1 THEN path_to_fna WHEN event_id % 3 = 0 THEN genome_path END AS fasta_path FROM paths""",
)
def choose_path(spark, d):
    from baseloom.operators.catalog import choose_fasta_path

    return choose_fasta_path(_paths(spark, d)).select("event_id", "fasta_path")


@query(
    "p08_repath",
    f"""WITH {_PATHS} SELECT event_id, CASE WHEN coalesce(path_to_fna, '') = '' THEN '' WHEN event_id % 7 IN (0, 1, 2) THEN '/new/genomes' || substring(path_to_fna, 14)
  ELSE path_to_fna END AS by_root, CASE WHEN event_id % 3 = 0 THEN '/new/genomes' || substring(genome_path, 3) ELSE genome_path END AS by_records FROM paths""",
)
def repath(spark, d):
    return _paths(spark, d).select(
        "event_id",
        CL.repath(F.col("path_to_fna"), "/new/genomes").alias("by_root"),
        CL.repath_records(F.col("genome_path"), "/new/genomes").alias("by_records"),
    )


@query(
    "p24_explode_values",
    """SELECT l_orderkey, value, count(*) AS n FROM (SELECT l_orderkey, unnest([l_quantity, l_tax]) AS value FROM lineitem) GROUP BY ALL""",
)
def explode_values(spark, d):
    text = F.concat_ws(";", F.col("l_quantity").cast("string"), F.lit("bad"), F.lit(" "), F.concat(F.lit(" "), F.col("l_tax").cast("string")))
    long = TR.explode_values(I.table(spark, d, "lineitem").select("l_orderkey", text.alias("values")), "values", "value")
    return long.groupBy("l_orderkey", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p20_genome_units",
    "SELECT p_partkey, round(p_retailprice * 978, 6) AS genome_size_mb, round(p_retailprice * 978 / 1000.0::DOUBLE, 6) AS genome_size_gb FROM part",
)
def units(spark, d):
    return rounded(TR.with_genome_units(I.table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").drop("p_retailprice"))


def measurements(spark, d):
    k = F.col("l_partkey")
    return TR.with_genome_units(
        I.table(spark, d, "lineitem").select(
            F.concat(F.lit("sp"), k % 400).alias("species_key"), F.concat(F.lit("Sp "), k % 400).alias("species_name"), F.col("l_extendedprice").alias("c_value_pg")
        ),
        "c_value_pg",
    )


_MEAS = "m AS (SELECT 'sp' || (l_partkey % 400) AS species_key, 'Sp ' || (l_partkey % 400) AS species_name, l_extendedprice AS v FROM lineitem)"


@query(
    "a16_c_value_summary",
    f"""WITH {_MEAS} SELECT species_key, species_name, count(*) AS n_measurements, min(v) AS min_c_value_pg, max(v) AS max_c_value_pg, round(avg(v), 3) AS mean_c_value_pg,
  round(coalesce(stddev_samp(v), 0), 3) AS std_c_value_pg, round(avg(v * 978), 3) AS mean_genome_mb, round(avg(v * 978 / 1000.0::DOUBLE), 3) AS mean_genome_gb,
  round(median(v), 3) AS median_c_value_pg FROM m GROUP BY ALL""",
)
def c_values(spark, d):
    return rounded(TR.c_value_summary(measurements(spark, d)), places=3)


@query(
    "a16_c_value_overall",
    f"""WITH {_MEAS} SELECT count(DISTINCT species_key) AS n_species, count(*) AS n_measurements, min(v) AS overall_min_pg, max(v) AS overall_max_pg,
  round(avg(v), 3) AS overall_mean_pg, round(median(v), 3) AS overall_median_pg FROM m""",
)
def c_overall(spark, d):
    return rounded(TR.c_value_overall(measurements(spark, d)), places=3)


@query(
    "t01_top_species",
    f"WITH {_MEAS} SELECT species_name, round(avg(v), 3) AS mean_c_value_pg FROM m GROUP BY species_name ORDER BY avg(v) DESC LIMIT 10",
)
def top_species(spark, d):
    means = measurements(spark, d).groupBy("species_name").agg(F.avg("c_value_pg").alias("mean_c_value_pg"))
    return rounded(R.top_k(means, [F.desc("mean_c_value_pg")], 10), places=3)


_STANDARD = f"""{I.NAMES_SQL}, {KEYED}, mass AS (SELECT species_normalized, first(number ORDER BY row_idx) AS mass_meiri FROM keyed
  WHERE number IS NOT NULL AND species_normalized <> 'unknown_species' GROUP BY species_normalized)"""


def mass_source(spark, d):
    return TR.standardize_trait(I.raw_names(spark, d), "raw_name", "value_text", "mass_meiri")


@query("n01_standardize_trait", f"WITH {_STANDARD} SELECT * FROM mass")
def standardize_trait(spark, d):
    return mass_source(spark, d)


@query(
    "n01_audit_names",
    f"""WITH {I.NAMES_SQL}, {KEYED} SELECT DISTINCT 'customers' AS source_dataset, trim(raw_name) AS source_species_name, species_normalized
  FROM keyed WHERE trim(raw_name) <> '' AND species_normalized <> 'unknown_species'""",
)
def audit_names(spark, d):
    return TR.audit_names(I.raw_names(spark, d), "raw_name", "customers")


def thermal_source(spark, d):
    k = F.col("l_orderkey")
    letters = F.translate((F.col("l_suppkey") % 97).cast("string"), "0123456789", "abcdefghij")
    more = F.translate((F.col("l_suppkey") % 131).cast("string"), "0123456789", "klmnopqrst")
    return (
        spread(I.table(spark, d, "lineitem"))
        .select(
            F.concat(F.lit("Genus"), letters).alias("genus"),
            F.concat(F.lit("spec"), more).alias("species"),
            F.when(k % 4 == 0, "x").otherwise(F.col("l_quantity").cast("string")).alias("tmax"),
            F.when(k % 3 == 0, "CT_max").when(k % 3 == 1, "lethal").alias("max_metric"),
            F.col("l_tax").cast("string").alias("tmin"),
            F.when(k % 7 == 0, "critical thermal minimum").otherwise("ltmin").alias("min_metric"),
            k.alias("_k"), "l_partkey", "l_linenumber", "l_extendedprice",
        )
        .withColumn("row_idx", F.struct("_k", "l_linenumber", "l_partkey", "l_extendedprice", "tmax", "tmin"))
        .drop("_k", "l_partkey", "l_linenumber", "l_extendedprice")
    )


_THERMAL = """th AS (SELECT lower('Genus' || translate(CAST(l_suppkey % 97 AS VARCHAR), '0123456789', 'abcdefghij') || '_spec' || translate(CAST(l_suppkey % 131 AS VARCHAR), '0123456789', 'klmnopqrst')) AS species_normalized,
    CASE WHEN l_orderkey % 3 = 0 AND l_orderkey % 4 <> 0 THEN l_quantity END AS x, CASE WHEN l_orderkey % 7 = 0 THEN l_tax END AS n,
    (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS o FROM lineitem),
  thermal AS (SELECT species_normalized, first(x ORDER BY o) FILTER (x IS NOT NULL) AS ct_max, CASE WHEN count(x) > 0 THEN 'CT_max' ELSE '' END AS ct_max_metric,
    first(n ORDER BY o) FILTER (n IS NOT NULL) AS ct_min, CASE WHEN count(n) > 0 THEN 'critical thermal minimum' ELSE '' END AS ct_min_metric, count(*) AS n_thermal_rows FROM th GROUP BY species_normalized)"""


@query("n02_standardize_thermal", f"WITH {_THERMAL} SELECT * FROM thermal")
def standardize_thermal(spark, d):
    return TR.standardize_thermal(thermal_source(spark, d))


@query(
    "a17_collapse_first",
    f"""WITH {I.NAMES_SQL}, {KEYED} SELECT species_normalized, first(value ORDER BY row_idx) FILTER (value IS NOT NULL) AS value,
  first(number ORDER BY row_idx) FILTER (number IS NOT NULL) AS number FROM keyed GROUP BY species_normalized""",
)
def collapse(spark, d):
    df = I.raw_names(spark, d).select(
        normalize_species(F.col("raw_name")).alias("species_normalized"), "row_idx", "value", CL.to_number(F.col("value_text")).alias("number")
    )
    return TR.collapse_by_species(df, ["value", "number"])


_HISTORY = f"""{_STANDARD}, {_THERMAL}, universe AS (SELECT species_normalized FROM keyed WHERE row_idx % 4 <> 3 UNION SELECT species_normalized FROM thermal),
  history AS (SELECT species_normalized, mass_meiri, ct_min, ct_max, row_number() OVER (ORDER BY species_normalized) AS species_pk
    FROM (SELECT * FROM universe WHERE species_normalized <> 'unknown_species') LEFT JOIN mass USING (species_normalized) LEFT JOIN thermal USING (species_normalized))"""


def universe(spark, d, thermal=None):
    reference = I.raw_names(spark, d).where(F.col("row_idx") % 4 != 3).select(normalize_species(F.col("raw_name")).alias("species_normalized"))
    return TR.species_universe(reference, thermal or TR.standardize_thermal(thermal_source(spark, d)))


def history(spark, d):
    thermal = stored(TR.standardize_thermal(thermal_source(spark, d)))
    return TR.natural_history(universe(spark, d, thermal), mass_source(spark, d), thermal.select("species_normalized", "ct_min", "ct_max"))


@query("u01_species_universe", f"WITH {_STANDARD}, {_THERMAL} SELECT species_normalized FROM keyed WHERE row_idx % 4 <> 3 AND species_normalized <> 'unknown_species' UNION SELECT species_normalized FROM thermal")
def species_universe(spark, d):
    return universe(spark, d)


@query("n03_natural_history", f"WITH {_HISTORY} SELECT * FROM history")
def natural_history(spark, d):
    return history(spark, d)


@query(
    "j18_species_audit",
    f"""WITH {_HISTORY}, a AS (SELECT DISTINCT 'customers' AS source_dataset, trim(raw_name) AS source_species_name, species_normalized FROM keyed
    WHERE trim(raw_name) <> '' AND species_normalized <> 'unknown_species' UNION ALL
    SELECT DISTINCT 'parts', p_name, {I.TAXON_SQL.format('p_name')} FROM part)
  SELECT a.*, species_pk, CASE WHEN species_pk IS NOT NULL THEN 'exact_match' WHEN split_part(species_normalized, '_', 1) IN
    (SELECT split_part(species_normalized, '_', 1) FROM history) THEN 'genus_match_only' ELSE 'no_match' END AS match_status,
    row_number() OVER (ORDER BY source_dataset, species_normalized, source_species_name) AS species_name_audit_pk FROM a LEFT JOIN history USING (species_normalized)""",
)
def species_audit(spark, d):
    names = TR.audit_names(I.raw_names(spark, d), "raw_name", "customers").unionByName(
        TR.audit_names(I.table(spark, d, "part"), "p_name", "parts")
    )
    return TR.species_audit(stored(names), stored(history(spark, d)))


_TRAITKEY = _MODES["trait"]


@query(
    "j18b_audit_lookup",
    f"""WITH {I.NAMES_SQL}, a AS (SELECT DISTINCT 'customers' AS source_dataset, trim(raw_name) AS source_species_name, {_TRAITKEY} AS species_normalized FROM names
    WHERE trim(raw_name) NOT IN ('', 'nan')), lk AS (SELECT {TAXON} AS species_normalized, max(row_idx) AS species_pk FROM names WHERE row_idx % 6 < 2 GROUP BY 1)
  SELECT a.*, species_pk, CASE WHEN species_normalized = 'unknown_species' THEN 'unknown_species' WHEN species_pk IS NOT NULL THEN 'matched_species_pk'
    ELSE 'normalized_not_in_species_lookup' END AS match_status FROM a LEFT JOIN lk USING (species_normalized)""",
)
def audit_lookup(spark, d):
    names = I.raw_names(spark, d)
    lookup = names.where(F.col("row_idx") % 6 < 2).groupBy(normalize_species(F.col("raw_name")).alias("species_normalized")).agg(F.max("row_idx").alias("species_pk"))
    return TR.audit_lookup(names.select(F.lit("customers").alias("source_dataset"), F.col("raw_name").alias("source_species_name")), lookup)


@query(
    "j18b_audit_without_lookup",
    f"""WITH {I.NAMES_SQL}, a AS (SELECT DISTINCT 'n' || nation AS source_dataset, trim(raw_name) AS source_species_name, {_TRAITKEY} AS species_normalized FROM names
    WHERE trim(raw_name) NOT IN ('', 'nan')) SELECT *, CAST(NULL AS BIGINT) AS species_pk, CASE WHEN species_normalized = 'unknown_species' THEN 'unknown_species'
    WHEN count(*) OVER (PARTITION BY source_dataset, species_normalized) > 1 THEN 'normalized_duplicate_within_source' ELSE 'normalized_no_species_lookup_provided' END AS match_status FROM a""",
)
def audit_no_lookup(spark, d):
    names = I.raw_names(spark, d)
    return TR.audit_lookup(names.select(F.concat(F.lit("n"), "nation").alias("source_dataset"), F.col("raw_name").alias("source_species_name")), None)


@query(
    "n04_project_species",
    f"WITH {I.NAMES_SQL} SELECT {_TRAITKEY} AS species_normalized, min(row_idx) AS row_idx FROM names WHERE {_TRAITKEY} <> 'unknown_species' GROUP BY 1",
)
def project_species(spark, d):
    return TR.project_species(I.raw_names(spark, d), "raw_name")


_SPECIES = "sp AS (SELECT DISTINCT 'genus_sp' || (c_custkey % 997) AS species_normalized FROM customer)"
_PT = """life AS (SELECT 'genus_sp' || (p_partkey % 1999) AS species_normalized, max(CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size AS DOUBLE) END) AS eggs_per_clutch,
    max(CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END) AS clutches_per_year FROM part GROUP BY 1),
  m1 AS (SELECT 'genus_sp' || s_suppkey AS species_normalized, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS mass_oskyrko FROM supplier),
  m2 AS (SELECT 'genus_sp' || c_custkey AS species_normalized, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS mass_title FROM customer),
  m3 AS (SELECT 'genus_sp' || p_partkey AS species_normalized, CASE WHEN p_partkey % 5 < 2 THEN p_retailprice END AS mass_ji FROM part)"""
_PTS = f"""{_SPECIES}, {_PT}, traits AS (SELECT species_normalized, eggs_per_clutch, clutches_per_year, mass_oskyrko, mass_title, mass_ji,
    coalesce(mass_oskyrko, mass_title, mass_ji) AS mass_preferred, CASE WHEN mass_oskyrko IS NOT NULL THEN 'oskyrko' WHEN mass_title IS NOT NULL THEN 'title'
    WHEN mass_ji IS NOT NULL THEN 'ji' ELSE '' END AS mass_source_preferred, eggs_per_clutch * clutches_per_year AS annual_number_of_eggs
  FROM sp LEFT JOIN life USING (species_normalized) LEFT JOIN m1 USING (species_normalized) LEFT JOIN m2 USING (species_normalized) LEFT JOIN m3 USING (species_normalized))"""


def _named(col):
    return F.concat(F.lit("genus_sp"), col).alias("species_normalized")


def project_traits_df(spark, d):
    part, supplier, customer = (I.table(spark, d, t) for t in ("part", "supplier", "customer"))
    p, s, c = F.col("p_partkey"), F.col("s_suppkey"), F.col("c_custkey")
    species = customer.select(_named(c % 997)).distinct()
    life = part.groupBy(_named(p % 1999)).agg(
        F.max(F.when(p % 3 > 0, F.col("p_size").cast("double"))).alias("eggs_per_clutch"), F.max(F.when(p % 4 > 0, F.col("p_retailprice"))).alias("clutches_per_year")
    )
    mass = [
        (supplier.select(_named(s), F.when(s % 2 == 0, F.col("s_acctbal")).alias("mass_oskyrko")), "mass_oskyrko", "oskyrko"),
        (customer.select(_named(c), F.when(c % 3 == 0, F.col("c_acctbal")).alias("mass_title")), "mass_title", "title"),
        (part.select(_named(p), F.when(p % 5 < 2, F.col("p_retailprice")).alias("mass_ji")), "mass_ji", "ji"),
    ]
    return TR.project_traits(species, life, mass)


@query("n05_project_traits", f"WITH {_PTS} SELECT * REPLACE (round(annual_number_of_eggs, 6) AS annual_number_of_eggs) FROM traits")
def project_traits(spark, d):
    return rounded(project_traits_df(spark, d))


@query("p22_prefer_traits", f"WITH {_PTS} SELECT species_normalized, mass_preferred, mass_source_preferred FROM traits")
def prefer(spark, d):
    return project_traits_df(spark, d).select("species_normalized", "mass_preferred", "mass_source_preferred")


@query(
    "n07_apply_overrides",
    f"""WITH {_PTS}, o AS (SELECT 'genus_sp' || p_partkey AS species_normalized, p_retailprice AS mass_value FROM part WHERE p_partkey % 3 = 0)
  SELECT species_normalized, coalesce(mass_preferred, mass_value) AS mass_preferred, CASE WHEN mass_value IS NOT NULL AND mass_source_preferred = '' THEN 'curated' ELSE mass_source_preferred END AS mass_source_preferred
  FROM traits LEFT JOIN o USING (species_normalized)""",
)
def overrides(spark, d):
    p = F.col("p_partkey")
    listed = I.table(spark, d, "part").where(p % 3 == 0).select(_named(p), F.col("p_retailprice").alias("mass_value"), F.lit("curated").alias("source"))
    return TR.apply_overrides(project_traits_df(spark, d), listed).select("species_normalized", "mass_preferred", "mass_source_preferred")


def model_table(spark, d):
    """Window summaries by customer: order price spread, and masses by nation."""
    orders = I.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.stddev_samp("o_totalprice").alias("sd_gc"), F.var_samp("o_totalprice").alias("var_gc"), (F.count(F.lit(1)) * 1000).alias("standard_window_size_bp")
    )
    customer = I.table(spark, d, "customer")
    c = F.col("c_custkey")
    return TR.with_log_traits(
        customer.join(orders, c == F.col("o_custkey"), "left").select(
            c.alias("genome_pk"), "sd_gc", "var_gc", "standard_window_size_bp",
            F.when(c % 3 == 0, F.col("c_acctbal")).alias("mass_meiri"), F.when(c % 3 == 1, F.lit(-1.0)).alias("mass_title"), F.when(c % 5 == 2, F.lit(2.5)).alias("mass_ji"),
        )
    )


_MODEL = """model AS (SELECT c_custkey AS genome_pk, sd_gc, var_gc, w AS standard_window_size_bp, mass_meiri, mass_title, mass_ji, w / 1000 AS window_kb, w / 1000000 AS window_mb, mass_g,
    CASE WHEN mass_g > 0 THEN log10(mass_g) END AS log10_mass_g, CASE WHEN var_gc > 0 THEN ln(var_gc) END AS log_var_gc, CASE WHEN sd_gc > 0 THEN ln(sd_gc) END AS log_sd_gc,
    CASE WHEN sd_gc > 0 THEN log10(sd_gc) END AS log10_sd_gc, CASE WHEN w > 0 THEN log10(w) END AS log10_window_bp FROM (SELECT *, coalesce(mass_meiri, mass_title, mass_ji) AS mass_g FROM (
    SELECT c_custkey, sd_gc, var_gc, w, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS mass_meiri, CASE WHEN c_custkey % 3 = 1 THEN -1.0::DOUBLE END AS mass_title,
      CASE WHEN c_custkey % 5 = 2 THEN 2.5::DOUBLE END AS mass_ji FROM customer LEFT JOIN (SELECT o_custkey, stddev_samp(o_totalprice) AS sd_gc, var_samp(o_totalprice) AS var_gc, count(*) * 1000 AS w FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)))"""
_LOGS = "genome_pk, mass_g, round(log10_mass_g, 6) AS log10_mass_g, round(log_var_gc, 6) AS log_var_gc, round(log_sd_gc, 6) AS log_sd_gc, round(log10_sd_gc, 6) AS log10_sd_gc, round(log10_window_bp, 6) AS log10_window_bp, window_kb, window_mb"
_LOG_COLUMNS = ["genome_pk", "mass_g", "log10_mass_g", "log_var_gc", "log_sd_gc", "log10_sd_gc", "log10_window_bp", "window_kb", "window_mb"]


@query("p21_log_traits", f"WITH {_MODEL} SELECT {_LOGS} FROM model")
def log_traits(spark, d):
    return rounded(model_table(spark, d).select(*_LOG_COLUMNS))


_USABLE = "sd_gc > 0 AND standard_window_size_bp > 0 AND mass_g > 0"


@query("f09_model_rows", f"WITH {_MODEL} SELECT {_LOGS} FROM model WHERE {_USABLE}")
def model_rows(spark, d):
    return rounded(TR.model_rows(model_table(spark, d)).select(*_LOG_COLUMNS))


@query("f09_excluded_rows", f"WITH {_MODEL} SELECT genome_pk FROM model WHERE NOT coalesce({_USABLE}, false)")
def excluded_rows(spark, d):
    return TR.excluded_rows(model_table(spark, d)).select("genome_pk")


@query("f08_complete_cases", f"WITH {_MODEL} SELECT genome_pk FROM model WHERE sd_gc IS NOT NULL AND mass_g IS NOT NULL AND var_gc IS NOT NULL")
def complete(spark, d):
    return TR.complete_cases(model_table(spark, d), ["sd_gc", "mass_g", "var_gc"]).select("genome_pk")


@query(
    "a27_missingness",
    f"WITH {_MODEL} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, count({c}) AS n_present FROM model" for c in ("sd_gc", "mass_g", "log10_mass_g")),
)
def missingness(spark, d):
    return ST.missingness(model_table(spark, d), ["sd_gc", "mass_g", "log10_mass_g"])


_NUM = {"q": "l_quantity", "p": "l_extendedprice", "t": "CASE WHEN l_orderkey % 3 > 0 THEN l_tax END"}
_NUMS = "x AS (SELECT l_suppkey, l_quantity AS q, l_extendedprice AS p, CASE WHEN l_orderkey % 3 > 0 THEN l_tax END AS t FROM lineitem)"


def _numbers(spark, d):
    return I.table(spark, d, "lineitem").select(
        "l_suppkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.when(F.col("l_orderkey") % 3 > 0, F.col("l_tax")).alias("t")
    )


@query(
    "a28_correlations",
    f"WITH {_NUMS} " + " UNION ALL ".join(f"SELECT '{a}' AS variable, {', '.join(f'round(corr({a}, {b}), 6) AS {b}' for b in 'qpt')} FROM x" for a in "qpt"),
)
def correlations(spark, d):
    return rounded(ST.correlations(_numbers(spark, d), ["q", "p", "t"]))


@query(
    "a29_ols_by",
    f"""WITH {_NUMS} SELECT l_suppkey, round(regr_intercept(t, q), 6) AS intercept, round(regr_slope(t, q), 6) AS slope, round(regr_r2(t, q), 6) AS r_squared, regr_count(t, q)::BIGINT AS n
  FROM x GROUP BY l_suppkey""",
)
def ols(spark, d):
    return rounded(ST.ols_by(_numbers(spark, d), ["l_suppkey"], "q", "t").select("l_suppkey", "intercept", "slope", "r_squared", "n"))


# Two-sided tail of Student's t for a slope by the finite series for whole degrees of freedom; with r2 = t^2 / (n - 2 + t^2)
# the angle of the series has r2 as its squared sine.
T_TAIL = """CASE WHEN n > 2 AND r2 < 1 THEN 1 - CASE WHEN n % 2 = 0
    THEN sqrt(r2) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) / sqrt(pi()) * (1 - r2) ** k))
    ELSE 2 / pi() * (asin(sqrt(r2)) + sqrt(r2 * (1 - r2)) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * (1 - r2) ** k)), 0)) END END"""


@query(
    "a29_ols_p_value",
    f"""WITH {_NUMS}, f AS (SELECT l_suppkey, regr_intercept(t, q) AS intercept, regr_slope(t, q) AS slope, regr_r2(t, q) AS r2, regr_count(t, q)::BIGINT AS n FROM x GROUP BY l_suppkey)
  SELECT l_suppkey, round(intercept, 6) AS intercept, round(slope, 6) AS slope, round(r2, 6) AS r_squared, n,
    round(CASE WHEN n > 2 AND r2 < 1 THEN sqrt(r2 * (n - 2) / (1 - r2)) END, 6) AS t_abs, round({T_TAIL}, 6) AS p_value FROM f""",
)
def ols_p(spark, d):
    return rounded(ST.ols_by(_numbers(spark, d), ["l_suppkey"], "q", "t"))


_R = "SELECT corr(q, p) AS a, corr(q, t) AS b, corr(p, t) AS c FROM x WHERE t IS NOT NULL"


@query(
    "a30_vif",
    f"""WITH {_NUMS}, r AS ({_R}), dt AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
  SELECT 'q' AS variable, round((1 - c * c) / det, 6) AS vif FROM dt UNION ALL SELECT 'p', round((1 - b * b) / det, 6) FROM dt UNION ALL SELECT 't', round((1 - a * a) / det, 6) FROM dt""",
)
def vif(spark, d):
    return rounded(ST.vif(_numbers(spark, d), ["q", "p", "t"]))


@query(
    "a36_profile",
    f"WITH {_NUMS} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, min({c}) AS min, max({c}) AS max FROM x" for c in "qpt"),
)
def profile(spark, d):
    return rounded(ST.profile(_numbers(spark, d), ["q", "p", "t"]))


@query("a36_value_counts", "SELECT CASE WHEN l_orderkey % 3 > 0 THEN l_tax END AS t, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY ALL")
def value_counts(spark, d):
    return ST.value_counts(_numbers(spark, d), ["t", "q"])


@query(
    "w12_model_ranking",
    """WITH f AS (SELECT l_suppkey, count(*) AS n, 2 + l_suppkey % 4 AS k, avg(l_quantity) AS aic FROM lineitem GROUP BY l_suppkey UNION ALL SELECT -1, 4, 3, 1.0),
  a AS (SELECT *, CASE WHEN n - k - 1 > 0 THEN aic + 2 * k * (k + 1) / CAST(n - k - 1 AS DOUBLE) END AS aicc FROM f), w AS (SELECT *, aicc - min(aicc) OVER () AS da FROM a)
  SELECT 'm' || l_suppkey AS model, n, k, round(aic, 6) AS aic, round(aicc, 6) AS aicc, round(da, 6) AS delta_aicc, round(exp(-0.5 * da) / sum(exp(-0.5 * da)) OVER (), 6) AS weight_aicc,
  CASE WHEN n - k - 1 > 0 THEN 'fit' ELSE 'skipped_too_few_complete_rows' END AS note FROM w""",
)
def model_ranking(spark, d):
    s = F.col("l_suppkey")
    fits = I.table(spark, d, "lineitem").groupBy(s).agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("aic")).select(
        F.concat(F.lit("m"), s).alias("model"), "n", (s % 4 + 2).alias("k"), "aic"
    )
    few = spark.range(1).select(F.lit("m-1").alias("model"), F.lit(4).cast("bigint").alias("n"), F.lit(3).cast("bigint").alias("k"), F.lit(1.0).alias("aic"))
    return rounded(ST.model_ranking(stored(fits.unionByName(few))))


def _species_summary(spark, d):
    s = F.col("l_suppkey")
    return I.table(spark, d, "lineitem").groupBy(_named(s)).agg(F.stddev_samp("l_quantity").alias("sd_gc3"), F.count(F.lit(1)).alias("n_orthologs"))


_SS = "ss AS (SELECT 'genus_sp' || l_suppkey AS species_normalized, stddev_samp(l_quantity) AS sd_gc3, count(*) AS n_orthologs FROM lineitem GROUP BY l_suppkey)"


def _intron_summary(spark, d):
    p = F.col("l_partkey")
    return I.table(spark, d, "lineitem").groupBy(_named(p)).agg(F.count(F.lit(1)).alias("n_introns"))


@query("j05_traits_x_orthologs", f"WITH {_PTS}, {_SS} SELECT species_normalized, mass_preferred, round(sd_gc3, 6) AS sd_gc3, n_orthologs FROM traits LEFT JOIN ss USING (species_normalized)")
def traits_x_orthologs(spark, d):
    return rounded(TR.traits_x_orthologs(project_traits_df(spark, d).select("species_normalized", "mass_preferred"), _species_summary(spark, d)))


@query(
    "j06_traits_x_orthologs_x_introns",
    f"""WITH {_PTS}, {_SS} SELECT species_normalized, mass_preferred, round(sd_gc3, 6) AS sd_gc3, n_orthologs, n_introns FROM traits LEFT JOIN ss USING (species_normalized)
  LEFT JOIN (SELECT 'genus_sp' || l_partkey AS species_normalized, count(*) AS n_introns FROM lineitem GROUP BY l_partkey) USING (species_normalized)""",
)
def three_way(spark, d):
    traits = project_traits_df(spark, d).select("species_normalized", "mass_preferred")
    return rounded(TR.traits_x_orthologs_x_introns(traits, _species_summary(spark, d), _intron_summary(spark, d)))


_EXT = """s AS (SELECT l_suppkey AS species_pk, stddev_samp(l_quantity) AS sd_gc3, row_number() OVER (ORDER BY stddev_samp(l_quantity), l_suppkey) - 1 AS r, count(*) OVER () AS n FROM lineitem GROUP BY l_suppkey),
  chosen AS (SELECT species_pk, sd_gc3, CASE WHEN r = 0 THEN 'min' WHEN r = n - 1 THEN 'max' ELSE 'median' END AS selection FROM s WHERE r IN (0, n // 2, n - 1))"""


def chosen_species(spark, d):
    summary = I.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("species_pk")).agg(F.stddev_samp("l_quantity").alias("sd_gc3"))
    return TR.extreme_species(stored(summary), "sd_gc3", "species_pk")


@query("w10_extreme_species", f"WITH {_EXT} SELECT species_pk, selection, round(sd_gc3, 6) AS sd_gc3 FROM chosen")
def extreme(spark, d):
    return rounded(chosen_species(spark, d))


@query(
    "j07_introns_for_extremes",
    f"""WITH {_EXT} SELECT l_orderkey AS intron_pk, o_orderkey AS ortholog_pk, c_custkey AS sequence_pk, c_nationkey AS genome_pk, species_pk, selection, count(*) AS n FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN chosen ON species_pk = c_nationkey % 10 * (SELECT count(*) // 10 FROM supplier) + 0 GROUP BY ALL""",
)
def introns_for_extremes(spark, d):
    step = I.table(spark, d, "supplier").agg(F.floor(F.count(F.lit(1)) / 10)).scalar()
    introns = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("intron_pk"), F.col("l_orderkey").alias("ortholog_pk"))
    orthologs = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("ortholog_pk"), F.col("o_custkey").alias("sequence_pk"))
    sequences = I.table(spark, d, "customer").select(F.col("c_custkey").alias("sequence_pk"), F.col("c_nationkey").alias("genome_pk"))
    genomes = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("genome_pk"), (F.col("n_nationkey") % 10 * step).alias("species_pk"))
    chosen = chosen_species(spark, d).select("species_pk", "selection")
    out = TR.introns_for_extremes(introns, orthologs, sequences, genomes, chosen)
    return out.groupBy("intron_pk", "ortholog_pk", "sequence_pk", "genome_pk", "species_pk", "selection").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j08_genome_summary_traits",
    f"""WITH {_HISTORY}, g AS (SELECT c_custkey AS genome_pk, 'GCA_' || c_custkey AS accession_id, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 60 END AS species_pk FROM customer)
  SELECT o_orderkey AS genome_summary_pk, genome_pk, accession_id, species_pk, species_normalized, mass_meiri, ct_min, ct_max FROM (SELECT o_orderkey, o_custkey AS genome_pk FROM orders)
  LEFT JOIN g USING (genome_pk) LEFT JOIN history USING (species_pk)""",
)
def summary_traits(spark, d):
    c = F.col("c_custkey")
    genomes = I.table(spark, d, "customer").select(c.alias("genome_pk"), F.concat(F.lit("GCA_"), c).alias("accession_id"), F.when(c % 4 > 0, c % 60).alias("species_pk"))
    summary = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("genome_summary_pk"), F.col("o_custkey").alias("genome_pk"))
    return TR.genome_summary_traits(summary, genomes, history(spark, d))


@query(
    "j02_build_genomes",
    f"""WITH {_HISTORY}, hk AS (SELECT translate(species_normalized, '.-', '__') AS species_normalized, max(species_pk) AS species_pk FROM history GROUP BY 1), m AS (SELECT row_idx, {_FULL} AS f, array_to_string(string_split({_FULL}, '_')[1:2], '_') AS two FROM names)
  SELECT 'GCA_' || row_idx AS accession, f AS species_ncbi, coalesce(a.species_pk, b.species_pk) AS species_pk, row_idx % 2 = 0 AS is_current, row_number() OVER (ORDER BY row_idx) AS genome_pk
  FROM m LEFT JOIN hk a ON a.species_normalized = f LEFT JOIN hk b ON b.species_normalized = two""",
)
def build_genomes(spark, d):
    manifest = I.raw_names(spark, d).select(
        F.concat(F.lit("GCA_"), "row_idx").alias("accession"), F.col("raw_name").alias("organism_name"), (F.col("row_idx") % 2 == 0).alias("is_current"), "row_idx"
    )
    return TR.build_genomes(manifest, history(spark, d))


def labels(spark, d):
    k = F.col("c_custkey")
    accession = F.concat(F.lit("x|GCA_"), k, F.lit(".1|y"))
    return I.table(spark, d, "customer").select(
        F.when(k % 3 == 0, accession).when(k % 3 == 1, F.concat(F.lit("Genus sp"), k % 200)).otherwise(F.lit(" ")).alias("label"), k.alias("row_idx")
    )


def label_manifest(spark, d):
    k = F.col("s_suppkey")
    return I.table(spark, d, "supplier").select(
        F.concat(F.lit("GCA_"), k - k % 2, F.lit(".1")).alias("accession"), F.concat(F.lit("Genus_Sp"), k % 40, F.lit("_sub")).alias("species_label"), k.alias("row_idx")
    )


_LAB = """lab AS (SELECT c_custkey AS row_idx, CASE c_custkey % 3 WHEN 0 THEN 'x|GCA_' || c_custkey || '.1|y' WHEN 1 THEN 'Genus sp' || (c_custkey % 200) ELSE ' ' END AS label,
    CASE WHEN c_custkey % 3 = 0 THEN 'GCA_' || c_custkey || '.1' END AS accession, CASE c_custkey % 3 WHEN 0 THEN 'x|gca_' || c_custkey || '.1|y' WHEN 1 THEN 'genus_sp' || (c_custkey % 200) ELSE 'unknown_species' END AS own FROM customer),
  mf AS (SELECT 'GCA_' || (s_suppkey - s_suppkey % 2) || '.1' AS accession, first('genus_sp' || (s_suppkey % 40) ORDER BY s_suppkey) AS sp FROM supplier GROUP BY 1),
  mapped AS (SELECT label, row_idx, accession, coalesce(sp, own) AS mapped_species, CASE WHEN sp IS NOT NULL THEN 'manifest_accession' ELSE 'normalized_label' END AS mapping_source FROM lab LEFT JOIN mf USING (accession))"""


@query("j17_map_labels", f"WITH {_LAB} SELECT * FROM mapped")
def map_labels(spark, d):
    return TR.map_labels(labels(spark, d), label_manifest(spark, d))


@query("j17_unmapped_labels", f"WITH {_LAB} SELECT row_idx FROM mapped WHERE mapped_species = 'unknown_species'")
def unmapped(spark, d):
    return TR.unmapped_labels(TR.map_labels(labels(spark, d), label_manifest(spark, d))).select("row_idx")


@query(
    "j17_duplicate_labels",
    f"WITH {_LAB} SELECT row_idx, mapped_species FROM mapped WHERE mapped_species <> 'unknown_species' QUALIFY row_number() OVER (PARTITION BY mapped_species ORDER BY row_idx) > 1",
)
def duplicates(spark, d):
    return TR.duplicate_labels(stored(TR.map_labels(labels(spark, d), label_manifest(spark, d)))).select("row_idx", "mapped_species")


def _resolve_sides(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    left = I.table(spark, d, "customer").select(
        F.when(c % 4 == 0, F.concat(F.lit("'Genus"), c % 50, F.lit(" sp"), c % 90, F.lit("'"))).when(c % 4 == 1, F.concat(F.lit("Genus"), c % 50, F.lit("_sp"), c % 90, F.lit("_sub")))
        .when(c % 4 == 2, F.concat(F.lit("us"), c % 60)).otherwise(F.concat(F.lit("pre Genus"), c % 60, F.lit(" sp"), c % 90, F.lit(" post"))).alias("label")
    )
    right = I.table(spark, d, "supplier").select(F.concat(F.lit("Genus"), s % 50, F.lit("."), F.lit("sp"), s % 90, F.when(s % 3 == 0, " [x]").otherwise("")).alias("label"), s.alias("row_idx"))
    return left, right


def _norm(e: str) -> str:
    return _LABEL.replace("raw_name", e)


_RES = f"""l AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN '''Genus' || (c_custkey % 50) || ' sp' || (c_custkey % 90) || '''' WHEN 1 THEN 'Genus' || (c_custkey % 50) || '_sp' || (c_custkey % 90) || '_sub'
    WHEN 2 THEN 'us' || (c_custkey % 60) ELSE 'pre Genus' || (c_custkey % 60) || ' sp' || (c_custkey % 90) || ' post' END AS label FROM customer),
  r AS (SELECT 'Genus' || (s_suppkey % 50) || '.sp' || (s_suppkey % 90) || CASE WHEN s_suppkey % 3 = 0 THEN ' [x]' ELSE '' END AS cand, s_suppkey AS i FROM supplier),
  l2 AS (SELECT label, {_norm('label')} AS nl, array_to_string(string_split({_norm('label')}, '_')[1:2], '_') AS kl FROM l),
  r2 AS (SELECT cand, i, {_norm('cand')} AS nr, array_to_string(string_split({_norm('cand')}, '_')[1:2], '_') AS kr FROM r),
  p AS (SELECT label, cand, i, CASE WHEN nl = nr THEN 1 WHEN kl = kr THEN 2 ELSE 3 END AS tier FROM l2 JOIN r2 ON nl = nr OR kl = kr OR contains(nl, nr) OR contains(nr, nl)),
  best AS (SELECT * FROM p QUALIFY tier = min(tier) OVER (PARTITION BY label))"""


@query(
    "j16_resolve_labels",
    f"""WITH {_RES} SELECT label, first(cand ORDER BY i) AS resolved, CASE WHEN max(tier) IS NULL THEN 'unmatched' ELSE ['exact_normalized', 'species_key', 'substring_normalized'][max(tier)] || CASE WHEN count(cand) > 1 THEN '_ambiguous' ELSE '' END END AS match_method,
  count(cand) AS n_candidates FROM l LEFT JOIN best USING (label) GROUP BY label""",
)
def resolve(spark, d):
    return TR.resolve_labels(*_resolve_sides(spark, d), substring=True)


@query("j16_candidates", f"WITH {_RES} SELECT kr AS key, cand AS candidate, i AS row_idx FROM r2 WHERE kr IN (SELECT kl FROM l2)")
def candidates(spark, d):
    return TR.candidates_of(*_resolve_sides(spark, d))


@query(
    "u03_overlap",
    """WITH a AS (SELECT DISTINCT o_custkey AS species_pk FROM orders), b AS (SELECT DISTINCT c_custkey + 100 AS species_pk FROM customer)
  SELECT coalesce(a.species_pk, b.species_pk) AS species_pk, CASE WHEN b.species_pk IS NULL THEN 'only_first' WHEN a.species_pk IS NULL THEN 'only_second' ELSE 'both' END AS side FROM a FULL JOIN b ON a.species_pk = b.species_pk""",
)
def overlap(spark, d):
    a = I.table(spark, d, "orders").select(F.col("o_custkey").alias("species_pk"))
    b = I.table(spark, d, "customer").select((F.col("c_custkey") + 100).alias("species_pk"))
    return TR.overlap(a, b, "species_pk")


@query(
    "u04_audit_union",
    f"""WITH {I.NAMES_SQL}, {KEYED} SELECT DISTINCT 'customers' AS source_dataset, trim(raw_name) AS source_species_name, species_normalized FROM keyed WHERE trim(raw_name) <> '' AND species_normalized <> 'unknown_species'
  UNION ALL SELECT DISTINCT 'parts', p_name, {I.TAXON_SQL.format('p_name')} FROM part""",
)
def audit_union(spark, d):
    return TR.audit_names(I.raw_names(spark, d), "raw_name", "customers").unionByName(TR.audit_names(I.table(spark, d, "part"), "p_name", "parts")).distinct()


@query(
    "w07_dedupe_first",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def dedupe(spark, d):
    return R.dedupe_first(I.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("w06_dense_ranks", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey DESC) AS place FROM orders")
def dense(spark, d):
    return R.dense_rank_desc(I.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "place").drop("o_custkey")


@query("t03_limit_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3")
def limit_group(spark, d):
    return R.limit_per_group(I.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3)


@query("t04_preview", "SELECT c_custkey, (SELECT count(*) - 25 FROM customer) AS n_more FROM customer ORDER BY c_custkey LIMIT 25")
def preview(spark, d):
    return R.preview(I.table(spark, d, "customer").select("c_custkey"), ["c_custkey"])


@query("t05_sample_genes", "SELECT 'g' || p_partkey AS gene FROM part ORDER BY md5('g' || p_partkey || ':7') LIMIT 300")
def sample(spark, d):
    return R.sample_rows(I.table(spark, d, "part").select(F.concat(F.lit("g"), "p_partkey").alias("gene")), "gene", 300, seed=7)
