"""Assembly catalogue, cohorts and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.functions.cleaning import FASTA_PATH_COLUMNS, is_genomic_fasta, to_integer
from baseloom.functions.names import accession_root, accession_version, normalize_species
from baseloom.operators.ranking import dedupe_first, dedupe_last, running_total
from baseloom.session import stored


def with_accession_parts(df: DataFrame, column: str = "accession") -> DataFrame:
    return df.withColumn("accession_root", accession_root(F.col(column))).withColumn(
        "accession_version", accession_version(F.col(column))
    )


def accession_aliases(df: DataFrame, column: str = "accession") -> DataFrame:
    """A row for the accession and one for it without version."""
    plain = F.regexp_replace(column, r"\.\d+$", "")
    return df.withColumn("alias", F.explode(F.array_distinct(F.array(F.col(column), plain))))


def choose_fasta_path(meta: DataFrame) -> DataFrame:
    """The first genomic FASTA path in the preferred columns."""
    columns = [c for c in FASTA_PATH_COLUMNS if c in meta.columns] or [
        c for c in meta.columns if any(w in c.lower() for w in ("path", "fna", "fasta"))
    ]
    if not columns:
        raise ValueError(f"no path column in {meta.columns}")

    def usable(name: str) -> Column:
        path = F.trim(F.col(name))
        return F.when((path != "") & (path != "\\N") & is_genomic_fasta(path), path)

    return meta.withColumn("fasta_path", F.coalesce(*[usable(c) for c in columns]))


def fasta_lookup(meta: DataFrame) -> DataFrame:
    """FASTA path by versioned and unversioned accession; the first row counts."""
    rows = accession_aliases(choose_fasta_path(meta).where(F.col("fasta_path").isNotNull()))
    return dedupe_first(rows.select("alias", "fasta_path", "row_idx"), ["alias"], ["row_idx"]).drop("row_idx")


def attach_fasta(meta: DataFrame, paths: DataFrame, strict: bool = True) -> DataFrame:
    """FASTA path per accession; with ``strict`` any miss is an error."""
    joined = meta.join(paths.select("accession", "path_to_fna"), "accession", "left")
    if strict:
        lost = joined.where(F.col("path_to_fna").isNull()).select("accession").orderBy("accession").limit(10).collect()
        if lost:
            raise ValueError("no FASTA path for " + ", ".join(r["accession"] for r in lost))
    return joined


def flatten_assembly(raw: DataFrame, at: str, search_term: str = "") -> DataFrame:
    """Nested summary to the catalogue's flat record; the time is given."""
    info = F.col("assembly_info")
    refseq = F.col("accession").startswith("GCF_")
    organism = F.coalesce("organism.organism_name", F.lit(""))
    level = F.coalesce(F.nullif(info["assembly_level"], F.lit("")), F.lit("chromosome"))
    stamp = F.lit(at).cast("timestamp")
    return raw.select(
        "accession",
        accession_root(F.col("accession")).alias("accession_root"),
        organism.alias("organism_name"),
        F.coalesce(F.col("organism.tax_id").cast("string"), F.lit("")).alias("taxon_id"),
        F.coalesce(info["assembly_name"], F.lit("")).alias("assembly_name"),
        level.alias("assembly_level"),
        F.coalesce(info["refseq_category"], F.lit("")).alias("refseq_category"),
        F.when(refseq, "RefSeq").otherwise("GenBank").alias("source_database"),
        refseq.alias("is_refseq"),
        F.lit(True).alias("is_current_for_species"),
        F.lit("").alias("replaced_by_accession"),
        normalize_species(organism, "ncbi").alias("species_key"),
        stamp.alias("downloaded_at"),
        stamp.alias("metadata_last_updated"),
        F.lit(search_term).alias("ncbi_search_term"),
        F.lit("").alias("notes"),
    )


def assembly_statistics(raw: DataFrame) -> DataFrame:
    """Reported counts per accession; zero and missing are NULL."""
    # Report fields and their columns.
    fields = {
        "totalNumberOfChromosomes": "ncbi_total_chromosomes",
        "numberOfScaffolds": "ncbi_number_scaffolds",
        "numberOfContigs": "ncbi_number_contigs",
        "numberOfComponentSequences": "ncbi_component_sequences",
    }
    return raw.select(
        F.col("accession").alias("accession_id"),
        *[F.nullif(to_integer(F.col(f"assemblyStats.{f}")), F.lit(0)).alias(c) for f, c in fields.items()],
    )


def select_accessions(
    manifest: DataFrame, mode: str, default: list[str] | None = None, n: int = 0, ids: list[str] | None = None
) -> DataFrame:
    """Accessions to build, in order, as ``accession, place``.

    ``default`` the default list; ``extra`` the defaults and the first ``n``
    others of the manifest; ``all`` the manifest; ``explicit`` the given ids.
    The lists are parameters of a run; missing ids or too few rows are an error.
    """
    spark = manifest.sparkSession
    rows = manifest.where(F.trim("accession") != "").groupBy(F.trim("accession").alias("accession")).agg(
        F.min("row_idx").alias("place")
    )
    if mode == "all":
        return rows
    given = list(dict.fromkeys((ids if mode == "explicit" else default) or []))
    listed = spark.createDataFrame([(a, i) for i, a in enumerate(given)], "accession string, place bigint")
    lost = [r["accession"] for r in listed.join(rows, "accession", "left_anti").orderBy("place").limit(10).collect()]
    if lost:
        raise ValueError("not in the manifest: " + ", ".join(lost))
    if mode in ("default", "explicit"):
        return listed
    if mode != "extra":
        raise ValueError(f"unknown mode {mode!r}")
    more = rows.join(listed.select("accession"), "accession", "left_anti").orderBy("place").limit(n)
    found = more.count()
    if found < n:
        raise ValueError(f"only {found} of {n} extra accessions in the manifest")
    return listed.unionByName(more.select("accession", (F.col("place") + len(given)).alias("place")))


def resolve_cohort(meta: DataFrame, allowed: DataFrame) -> DataFrame:
    """One metadata row per requested accession root.

    Exact accessions come first; roots without one take their newest version.
    Then one row per root stays: highest version, then smallest accession.
    """
    parts = with_accession_parts(meta.withColumn("accession", F.trim("accession")))
    wanted = allowed.select(F.trim("accession").alias("accession")).distinct()
    roots = wanted.select(accession_root(F.col("accession")).alias("accession_root")).distinct()
    exact = parts.join(wanted, "accession", "left_semi")
    open_roots = roots.join(exact.select("accession_root"), "accession_root", "left_anti")
    fallback = parts.join(open_roots, "accession_root", "left_semi")
    both = exact.unionByName(fallback).withColumn("_down", -F.col("accession_version"))
    return dedupe_first(both, ["accession_root"], ["_down", "accession"]).drop("_down")


def missing_roots(resolved: DataFrame, allowed: DataFrame) -> DataFrame:
    roots = allowed.select(accession_root(F.col("accession")).alias("accession_root")).distinct()
    return roots.join(resolved, "accession_root", "left_anti")


def exact_cohort(meta: DataFrame, allowed: DataFrame) -> DataFrame:
    return meta.join(allowed.select("accession"), "accession", "left_semi")


def missing_from(wanted: DataFrame, have: DataFrame, key: str = "accession") -> DataFrame:
    """Distinct keys of the first table that the second lacks."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


ACCESSION = r"GC[AF]_[0-9]+(\.[0-9]+)?"


def uncovered_accessions(meta: DataFrame, other: DataFrame, column: str = "accession") -> DataFrame:
    """Assembly accessions (entries with ``GC``) that another table lacks; accessions are compared whole, with their version."""
    found = F.regexp_extract(column, ACCESSION, 0)
    key = F.when(found != "", found).otherwise(F.trim(column)).alias("accession")
    listed = meta.where(F.col(column).contains("GC")).select(key).distinct()
    return listed.join(other.select(key), "accession", "left_anti")


def new_entries(updates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries whose accession is not in the catalogue; keys are compared whole."""
    return updates.join(catalog.select("accession"), "accession", "left_anti")


def project_accessions(*sources: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Trimmed distinct accessions in source order, else the fallback's.

    Each source has ``accession, row_idx``.
    """

    def listed(df: DataFrame, place: int) -> DataFrame:
        return df.select(F.trim("accession").alias("accession"), F.struct(F.lit(place).alias("s"), F.col("row_idx").cast("bigint").alias("r")).alias("_o"))

    rows = listed(sources[0], 0)
    for i, source in enumerate(sources[1:], 1):
        rows = rows.unionByName(listed(source, i))
    rows = rows.where("accession <> ''")
    if fallback is not None:
        empty = rows.agg(F.count(F.lit(1))).scalar() == 0
        rows = rows.unionByName(listed(fallback, len(sources)).where("accession <> ''").where(empty))
    return rows.groupBy("accession").agg(F.min("_o").alias("_o")).select(
        "accession", F.col("_o.s").cast("bigint").alias("source"), F.col("_o.r").alias("row_idx")
    )


def lookup_genome(meta: DataFrame, wanted: str) -> DataFrame:
    """The one genome that has this accession, path or organism name."""
    key = normalize_species(F.lit(wanted), "shell")
    hit = meta.where(
        (F.col("accession") == wanted)
        | (F.col("path_to_fna") == wanted)
        | (normalize_species(F.col("organism_name"), "shell") == key)
    )
    found = hit.limit(2).count()
    if found != 1:
        raise LookupError(f"{'no' if found == 0 else 'more than one'} genome matches {wanted!r}")
    return hit


def retry_queue(failures: DataFrame) -> DataFrame:
    return failures.where(F.trim("accession") != "").select(F.trim("accession").alias("accession")).distinct()


def drop_resolved(failures: DataFrame, done: DataFrame) -> DataFrame:
    return failures.join(done.select("accession"), "accession", "left_anti")


def current_assemblies(df: DataFrame) -> DataFrame:
    """The current assembly per species: RefSeq first, then the highest accession.

    The others are replaced by it. Rows without species key stand for
    themselves by accession root.
    """
    key = F.coalesce(F.nullif(F.trim("species_key"), F.lit("")), accession_root(F.col("accession")))
    rows = df.withColumn("species_key", key)
    refseq = F.col("accession").startswith("GCF_").cast("int")
    best = rows.groupBy("species_key").agg(
        F.max(F.struct(refseq.alias("r"), F.col("accession").alias("a"))).getField("a").alias("_best")
    )
    current = F.col("accession") == F.col("_best")
    return (
        rows.join(best, "species_key")
        .withColumn("is_current_for_species", current)
        .withColumn("replaced_by_accession", F.when(current, F.lit("")).otherwise(F.col("_best")))
        .drop("_best")
    )


def apply_updates(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogue after new accessions of ``new`` (with ``seq``, their order).

    Each new accession supersedes all other rows its species has at that time;
    a later one wins. A row that comes after the last other accession of its
    species stays current.
    """
    latest = dedupe_last(new, ["accession"], ["seq"])
    kept = existing.join(new.select("accession"), "accession", "left_anti").withColumn("seq", F.lit(-1).cast("bigint"))
    rows = kept.unionByName(latest.select(*existing.columns, F.col("seq").cast("bigint").alias("seq")))
    # The two latest distinct accessions of a species are enough to find the
    # last other one for each row.
    per = new.groupBy("species_key", "accession").agg(F.max("seq").alias("_at"))
    tops = per.groupBy("species_key").agg(F.max(F.struct("_at", "accession")).alias("_last"))
    second = (
        per.join(tops, "species_key")
        .where(F.col("accession") != F.col("_last.accession"))
        .groupBy("species_key")
        .agg(F.max(F.struct("_at", "accession")).alias("_second"))
    )
    joined = rows.join(tops, "species_key", "left").join(second, "species_key", "left")
    mine = F.col("accession") == F.col("_last.accession")
    other = F.when(mine, F.col("_second")).otherwise(F.col("_last"))
    superseded = F.coalesce(other["_at"] > F.col("seq"), F.lit(False))
    return joined.select(
        *[c for c in existing.columns if c not in ("is_current_for_species", "replaced_by_accession")],
        (F.col("is_current_for_species") & ~superseded).alias("is_current_for_species"),
        F.when(superseded, other["accession"]).otherwise(F.col("replaced_by_accession")).alias("replaced_by_accession"),
    )


def supersession_events(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One event per new accession, with the number of rows it supersedes.

    These are all rows its species has at that time but its own. Which ones
    follows from the order; listing them per event would grow with the square
    of a species' rows. The running counts are kept over key ranges, so one
    species may hold most of the rows.
    """
    key = ["species_key", "accession"]
    old = existing.select(*key).distinct()
    known = old.withColumn("_old", F.lit(1))
    first = new.groupBy(*key).agg(F.min("seq").alias("_first"))
    rows = (
        new.select(*key, F.col("seq").cast("bigint").alias("seq"))
        .join(known, key, "left")
        .join(first, key)
        .withColumn("_adds", F.when(F.col("_old").isNull() & (F.col("seq") == F.col("_first")), 1).otherwise(0))
        .withColumn("_own", F.when(F.col("_old").isNotNull() | (F.col("seq") > F.col("_first")), 1).otherwise(0))
    )
    running = stored(running_total(rows, ["species_key", "seq"], "_adds", "_before"))
    starts = running.groupBy("species_key").agg(F.min("_before").alias("_start"))
    present = old.groupBy("species_key").agg(F.count(F.lit(1)).alias("_present"))
    n = F.coalesce("_present", F.lit(0)) + F.col("_before") - F.col("_start") - F.col("_own")
    return (
        running.join(starts, "species_key")
        .join(present, "species_key", "left")
        .select("species_key", F.col("accession").alias("new_accession"), "seq", n.cast("bigint").alias("n_superseded"))
        .where("n_superseded > 0")
    )


def dedupe_refseq(df: DataFrame) -> DataFrame:
    """One accession per organism: the highest, so RefSeq before GenBank."""
    return df.groupBy("organism_name").agg(F.max("accession").alias("accession"))


def multi_accession(df: DataFrame) -> DataFrame:
    """Accessions of organisms that have more than one, with their row order."""
    several = df.groupBy("organism_name").agg(F.count(F.lit(1)).alias("n_accessions")).where("n_accessions > 1")
    return df.select("organism_name", "accession", "row_idx").join(several, "organism_name")


def append_catalog(catalog: DataFrame, entries: DataFrame, fetched: DataFrame) -> DataFrame:
    return catalog.unionByName(entries.join(fetched.select("accession"), "accession", "left_semi"))


def species_index(assemblies: DataFrame) -> DataFrame:
    """Projection of the catalogue with a status word."""
    return assemblies.select(
        "species_key",
        "organism_name",
        "accession",
        F.when(F.col("is_current_for_species"), "current").otherwise("superseded").alias("status"),
        "replaced_by_accession",
        F.lit("0").alias("project_count"),
        F.lit("").alias("notes"),
    )


def project_manifest(
    assemblies: DataFrame, ids: DataFrame, project: str, policy: str, version: str, date: str
) -> DataFrame:
    """Frozen list of a project's assemblies."""
    return assemblies.join(ids.select("accession"), "accession", "left_semi").select(
        F.lit(project).alias("project_name"),
        F.lit(policy).alias("project_policy"),
        F.lit(version).alias("manifest_version"),
        F.lit(date).cast("date").alias("manifest_date"),
        "species_key",
        "organism_name",
        "accession",
        F.lit("focal").alias("project_role"),
        F.col("is_current_for_species").alias("is_current_for_species_at_freeze"),
    )


def upsert(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those with the same key."""
    return df.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_metadata(df: DataFrame, new: DataFrame) -> DataFrame:
    """A row replaces that of its accession and lineage; exact repeats count once, and of several new rows the last stays.

    The last is the one with the largest ``row_idx``, where there is such a column, and else the largest in column order.
    """
    keys = ["accession", "lineage"]
    order = ["row_idx"] if "row_idx" in new.columns else []
    rest = [c for c in new.columns if c not in (*keys, *order)]
    last = new.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("last"))
    last = last.select(*keys, *[F.col("last").getField(c).alias(c) for c in new.columns if c in df.columns and c not in keys])
    return upsert(df, last, keys).distinct()


def rebuild_catalog(local: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue rows of the accessions found locally, with bare rows for unknown ones."""
    ids = local.select(F.trim("accession").alias("accession")).distinct()
    known = catalog.select("accession", "organism_name", "species_key", "assembly_level")
    joined = ids.join(known, "accession", "left")
    rows = joined.select(
        "accession",
        F.coalesce("organism_name", F.lit("")).alias("organism_name"),
        F.coalesce("species_key", F.lit("")).alias("species_key"),
        F.coalesce("assembly_level", F.lit("")).alias("assembly_level"),
        F.when(F.col("organism_name").isNull(), "local only").otherwise("").alias("notes"),
    )
    return current_assemblies(rows)


def rebuild_diff(current: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Accessions only in the current or only in the rebuilt catalogue."""
    lost = missing_from(current, rebuilt).select("accession", F.lit("missing").alias("change"))
    return lost.unionByName(missing_from(rebuilt, current).select("accession", F.lit("new").alias("change")))


def build_run_manifest(features: DataFrame | None, assemblies: DataFrame, default_lineage: str) -> DataFrame:
    """Runs: feature metadata with genome paths, or all assemblies without metadata."""
    path = F.coalesce(F.nullif(F.col("path_to_fna"), F.lit("")), F.nullif(F.col("pathway_to_genome"), F.lit("")))
    genomes = assemblies.select("accession", "organism_name", path.alias("genome_fna")).where(
        F.col("genome_fna").isNotNull()
    )
    species = normalize_species(F.col("organism_name"), "binomial")
    if features is None:
        return genomes.select("accession", species.alias("species"), "genome_fna", F.lit(default_lineage).alias("lineage"))
    return features.join(genomes, "accession").select(
        "accession", species.alias("species"), "genome_fna", F.coalesce("lineage", F.lit(default_lineage)).alias("lineage")
    )


def run_manifest_warnings(features: DataFrame, assemblies: DataFrame) -> DataFrame:
    """Accessions that are unknown or have no genome path."""
    unknown = missing_from(features, assemblies).withColumn("warning", F.lit("accession_missing"))
    path = F.coalesce(F.nullif(F.col("path_to_fna"), F.lit("")), F.nullif(F.col("pathway_to_genome"), F.lit("")))
    bare = assemblies.where(path.isNull()).join(features.select("accession"), "accession", "left_semi")
    return unknown.unionByName(bare.select("accession", F.lit("no_genome_path").alias("warning")))


def status_tally(df: DataFrame, ok: Column) -> DataFrame:
    """Units by SUCCESS and FAILED."""
    return df.groupBy(F.when(ok, "SUCCESS").otherwise("FAILED").alias("status")).agg(F.count(F.lit(1)).alias("n"))
