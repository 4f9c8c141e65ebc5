"""Trait sources, species names, audits and joined tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.functions.cleaning import is_critical_limit, to_number
from baseloom.functions.names import UNKNOWN, extract_accession, genus_of, normalize_species
from baseloom.operators.ranking import assign_pk, collapse_first, dedupe_first
from baseloom.operators.ranking import exact_quantiles
from baseloom.operators.validate import join_validated
from baseloom.session import stored

# Picograms of DNA to megabases.
MB_PER_PG = 978


def standardize_trait(df: DataFrame, name: str, value: str, out: str, mode: str = "taxon") -> DataFrame:
    """One trait source by species key: numbers only, first row per species.

    ``df`` has ``row_idx`` as its row order.
    """
    # Raw names repeat: each is reduced to its first row before it is normalised.
    number = to_number(F.col(value))
    firsts = (
        df.select(F.col(name).alias("_raw"), number.alias(out), "row_idx")
        .where(F.col(out).isNotNull())
        .groupBy("_raw")
        .agg(F.min(F.struct("row_idx", out)).alias("_f"))
    )
    keyed = firsts.select(normalize_species(F.col("_raw"), mode).alias("species_normalized"), "_f")
    best = keyed.groupBy("species_normalized").agg(F.min("_f").alias("_f"))
    return best.where(F.col("species_normalized") != UNKNOWN).select("species_normalized", F.col(f"_f.{out}").alias(out))


def audit_names(df: DataFrame, name: str, source: str, mode: str = "taxon") -> DataFrame:
    """Distinct source names of a trait source with their species key."""
    raw = F.trim(F.col(name))
    return (
        df.where(raw != "")
        .select(
            F.lit(source).alias("source_dataset"),
            raw.alias("source_species_name"),
            normalize_species(raw, mode).alias("species_normalized"),
        )
        .where(F.col("species_normalized") != UNKNOWN)
        .distinct()
    )


def standardize_thermal(df: DataFrame, mode: str = "taxon") -> DataFrame:
    """Critical limits per species: the first value whose label is a critical limit.

    ``df`` has ``genus, species, tmax, max_metric, tmin, min_metric, row_idx``.
    """
    def limit(kind: str, value: str, label: str) -> Column:
        return F.when(is_critical_limit(F.col(label), kind), to_number(F.col(value)))

    # The numbers are parsed once, in a projection of their own.
    parsed = df.select(
        "genus",
        "species",
        "row_idx",
        "max_metric",
        "min_metric",
        limit("max", "tmax", "max_metric").alias("_vmax"),
        limit("min", "tmin", "min_metric").alias("_vmin"),
    )

    def first(value: str, label: str) -> Column:
        row = F.struct(F.col("row_idx").alias("o"), F.col(value).alias("v"), F.col(label).alias("m"))
        return F.min(F.when(F.col(value).isNotNull(), row))

    # Raw names repeat: each is reduced before it is normalised.
    per_name = parsed.groupBy("genus", "species").agg(
        first("_vmax", "max_metric").alias("_max"),
        first("_vmin", "min_metric").alias("_min"),
        F.count(F.lit(1)).alias("_n"),
    )
    name = F.concat_ws(" ", F.coalesce("genus", F.lit("nan")), F.coalesce("species", F.lit("nan")))
    keyed = per_name.withColumn("species_normalized", normalize_species(name, mode))
    best = keyed.groupBy("species_normalized").agg(
        F.min("_max").alias("_max"), F.min("_min").alias("_min"), F.sum("_n").alias("n_thermal_rows")
    )
    return best.where(F.col("species_normalized") != UNKNOWN).select(
        "species_normalized",
        F.col("_max.v").alias("ct_max"),
        F.coalesce("_max.m", F.lit("")).alias("ct_max_metric"),
        F.col("_min.v").alias("ct_min"),
        F.coalesce("_min.m", F.lit("")).alias("ct_min_metric"),
        "n_thermal_rows",
    )


def collapse_by_species(df: DataFrame, columns: list[str]) -> DataFrame:
    return collapse_first(df, ["species_normalized"], columns, "row_idx")


def species_universe(*sources: DataFrame) -> DataFrame:
    """Distinct known species over all sources."""
    names = sources[0].select("species_normalized")
    for source in sources[1:]:
        names = names.unionByName(source.select("species_normalized"))
    return names.where(F.col("species_normalized").isNotNull() & (F.col("species_normalized") != UNKNOWN)).distinct()


def natural_history(universe: DataFrame, *traits: DataFrame) -> DataFrame:
    """All species with their traits, numbered alphabetically."""
    out = universe
    for trait in traits:
        out = out.join(trait, "species_normalized", "left")
    return assign_pk(out, ["species_normalized"], "species_pk")


def species_audit(names: DataFrame, history: DataFrame) -> DataFrame:
    """Match of each source name: the species, else its genus, else none."""
    keys = history.select("species_normalized", "species_pk")
    genera = history.select(genus_of(F.col("species_normalized")).alias("_genus")).distinct()
    distinct = names.select("source_dataset", "source_species_name", "species_normalized").distinct()
    joined = (
        distinct.join(keys, "species_normalized", "left")
        .withColumn("_genus", genus_of(F.col("species_normalized")))
        .join(genera.withColumn("_known", F.lit(True)), "_genus", "left")
    )
    status = (
        F.when(F.col("species_pk").isNotNull(), "exact_match")
        .when(F.col("_known"), "genus_match_only")
        .otherwise("no_match")
    )
    order = ["source_dataset", "species_normalized", "source_species_name"]
    return assign_pk(joined.withColumn("match_status", status).drop("_genus", "_known"), order, "species_name_audit_pk")


def audit_lookup(names: DataFrame, lookup: DataFrame | None, mode: str = "trait") -> DataFrame:
    """Status of each source name against a species lookup.

    Without a lookup, names that share a key inside a source are marked.
    """
    raw = F.trim(F.col("source_species_name"))
    # Words for a missing name.
    rows = names.where((raw != "") & ~F.lower(raw).isin("nan", "none", "na", "n/a")).select(
        "source_dataset", raw.alias("source_species_name"), normalize_species(raw, mode).alias("species_normalized")
    ).distinct()
    unknown = F.col("species_normalized") == UNKNOWN
    if lookup is None:
        shared = rows.groupBy("source_dataset", "species_normalized").agg((F.count(F.lit(1)) > 1).alias("_shared"))
        return rows.join(shared, ["source_dataset", "species_normalized"]).select(
            *rows.columns,
            F.lit(None).cast("bigint").alias("species_pk"),
            F.when(unknown, "unknown_species")
            .when(F.col("_shared"), "normalized_duplicate_within_source")
            .otherwise("normalized_no_species_lookup_provided")
            .alias("match_status"),
        )
    return rows.join(lookup.select("species_normalized", "species_pk"), "species_normalized", "left").withColumn(
        "match_status",
        F.when(unknown, "unknown_species")
        .when(F.col("species_pk").isNotNull(), "matched_species_pk")
        .otherwise("normalized_not_in_species_lookup"),
    )


def project_species(df: DataFrame, name: str) -> DataFrame:
    """Species of a project's manifest, each once in row order."""
    rows = df.select(normalize_species(F.col(name), "trait").alias("species_normalized"), "row_idx").where(
        F.col("species_normalized") != UNKNOWN
    )
    return rows.groupBy("species_normalized").agg(F.min("row_idx").alias("row_idx"))


def prefer_traits(df: DataFrame, order: dict[str, str], out: str, source: str) -> DataFrame:
    """First non-NULL column in priority order, and which one it was."""
    label = F.lit("")
    for column, name in reversed(list(order.items())):
        label = F.when(F.col(column).isNotNull(), F.lit(name)).otherwise(label)
    return df.withColumn(out, F.coalesce(*order)).withColumn(source, label)


def project_traits(species: DataFrame, life: DataFrame, mass: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Project species with life-history traits and the preferred mass; all species kept.

    ``mass`` lists the mass tables with their column and source name, best first.
    """
    out = species.select("species_normalized").join(life, "species_normalized", "left")
    for table, column, _ in mass:
        out = out.join(table.select("species_normalized", column), "species_normalized", "left")
    out = prefer_traits(out, {c: n for _, c, n in mass}, "mass_preferred", "mass_source_preferred")
    return out.withColumn("annual_number_of_eggs", F.col("eggs_per_clutch") * F.col("clutches_per_year"))


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Curated masses for listed species whose preferred mass is missing.

    The curated source also names a value whose source is blank. No species is
    added.
    """
    listed = overrides.select(
        "species_normalized", F.col("mass_value").alias("_mass"), F.col("source").alias("_source")
    )
    unnamed = F.col("mass_source_preferred").isNull() | (F.trim("mass_source_preferred") == "")
    return (
        df.join(listed, "species_normalized", "left")
        .withColumn(
            "mass_source_preferred",
            F.when(F.col("_source").isNotNull() & unnamed, F.col("_source")).otherwise(F.col("mass_source_preferred")),
        )
        .withColumn("mass_preferred", F.coalesce("mass_preferred", "_mass"))
        .drop("_mass", "_source")
    )


def explode_values(df: DataFrame, column: str, out: str) -> DataFrame:
    """One row per number of a ``;`` list; what is no number is dropped."""
    return df.withColumn(out, F.explode(F.split(column, ";"))).withColumn(
        out, F.trim(out).try_cast("double")
    ).where(F.col(out).isNotNull()).drop(column)


def with_genome_units(df: DataFrame, pg: str) -> DataFrame:
    return df.withColumn("genome_size_mb", F.col(pg) * MB_PER_PG).withColumn(
        "genome_size_gb", F.col(pg) * MB_PER_PG / 1000.0
    )


def c_value_summary(long: DataFrame) -> DataFrame:
    """Measurements per species; one value has spread 0."""
    keys = ["species_key", "species_name"]
    median = exact_quantiles(long, keys, "c_value_pg", {"median_c_value_pg": 0.5})
    pg = F.col("c_value_pg")
    return (
        long.groupBy(*keys)
        .agg(
            F.count(pg).alias("n_measurements"),
            F.min(pg).alias("min_c_value_pg"),
            F.max(pg).alias("max_c_value_pg"),
            F.avg(pg).alias("mean_c_value_pg"),
            F.coalesce(F.stddev_samp(pg), F.lit(0.0)).alias("std_c_value_pg"),
            F.avg("genome_size_mb").alias("mean_genome_mb"),
            F.avg("genome_size_gb").alias("mean_genome_gb"),
        )
        .join(median, keys, "left")
    )


def c_value_overall(long: DataFrame) -> DataFrame:
    """One row over all measurements."""
    median = exact_quantiles(long.withColumn("_all", F.lit(1)), ["_all"], "c_value_pg", {"m": 0.5})
    return long.agg(
        F.countDistinct("species_key", "species_name").alias("n_species"),
        F.count("c_value_pg").alias("n_measurements"),
        F.min("c_value_pg").alias("overall_min_pg"),
        F.max("c_value_pg").alias("overall_max_pg"),
        F.avg("c_value_pg").alias("overall_mean_pg"),
    ).withColumn("overall_median_pg", median.select("m").scalar())


def with_log_traits(df: DataFrame) -> DataFrame:
    """Window size in kb and Mb, first known mass, logarithms; NULL where not positive."""

    def log_of(fn, name: str) -> Column:
        return F.when(F.col(name) > 0, fn(F.col(name)))

    return (
        df.withColumn("window_kb", F.col("standard_window_size_bp") / 1000)
        .withColumn("window_mb", F.col("standard_window_size_bp") / 1000000)
        .withColumn("mass_g", F.coalesce("mass_meiri", "mass_title", "mass_ji"))
        .withColumn("log10_mass_g", log_of(F.log10, "mass_g"))
        .withColumn("log_var_gc", log_of(F.log, "var_gc"))
        .withColumn("log_sd_gc", log_of(F.log, "sd_gc"))
        .withColumn("log10_sd_gc", log_of(F.log10, "sd_gc"))
        .withColumn("log10_window_bp", log_of(F.log10, "standard_window_size_bp"))
    )


_MODEL = "sd_gc > 0 AND standard_window_size_bp > 0 AND mass_g > 0"


def model_rows(df: DataFrame) -> DataFrame:
    """Rows that a log model can use."""
    return df.where(_MODEL)


def excluded_rows(df: DataFrame) -> DataFrame:
    """The complement: rows with a NULL or a value that is not positive."""
    return df.where(f"NOT coalesce({_MODEL}, false)")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def genome_summary_traits(summary: DataFrame, genomes: DataFrame, history: DataFrame) -> DataFrame:
    """Genome window summaries with accession and traits."""
    return summary.join(genomes.select("genome_pk", "accession_id", "species_pk"), "genome_pk", "left").join(
        history, "species_pk", "left"
    )


def traits_x_orthologs(traits: DataFrame, summary: DataFrame) -> DataFrame:
    """Traits with ortholog summaries; the summary must be unique per species."""
    return join_validated(traits, summary, ["species_normalized"], "left", "m:1")


def traits_x_orthologs_x_introns(traits: DataFrame, orthologs: DataFrame, introns: DataFrame) -> DataFrame:
    """Two hops; the first must be one to one."""
    first = join_validated(traits, orthologs, ["species_normalized"], "left", "1:1")
    return join_validated(first, introns, ["species_normalized"], "left", "m:1")


def extreme_species(summary: DataFrame, value: str, key: str) -> DataFrame:
    """The species with the lowest, middle and highest value."""
    ranked = assign_pk(summary.where(F.col(value).isNotNull()).select(key, value), [value, key], "_place")
    n = ranked.agg(F.count(F.lit(1))).scalar()
    middle = F.floor(n / 2) + 1
    label = F.when(F.col("_place") == 1, "min").when(F.col("_place") == n, "max").otherwise("median")
    return (
        ranked.withColumn("_n", n)
        .withColumn("_middle", middle)
        .where((F.col("_place") == 1) | (F.col("_place") == F.col("_middle")) | (F.col("_place") == F.col("_n")))
        .withColumn("selection", label)
        .drop("_place", "_n", "_middle")
    )


def introns_for_extremes(
    introns: DataFrame, orthologs: DataFrame, sequences: DataFrame, genomes: DataFrame, chosen: DataFrame
) -> DataFrame:
    """Introns of the chosen species, through gene, sequence and genome.

    The three chosen species go first, so only their genomes' rows are joined.
    """
    return (
        introns.join(orthologs.select("ortholog_pk", "sequence_pk"), "ortholog_pk", "left")
        .join(sequences.select("sequence_pk", "genome_pk"), "sequence_pk", "left")
        .join(genomes.select("genome_pk", "species_pk"), "genome_pk", "left")
        .join(chosen, "species_pk")
    )


def relabel(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Accession to ``Genus_species``; unknown accessions keep theirs."""
    names = mapping.groupBy(F.col("accession").alias("sequence_id")).agg(
        F.min(normalize_species(F.col("organism_name"), "display")).alias("_label")
    )
    return df.join(names, "sequence_id", "left").withColumn("label", F.coalesce("_label", "sequence_id")).drop("_label")


def build_genomes(manifest: DataFrame, history: DataFrame) -> DataFrame:
    """Genome rows with the species key by full name, else by genus and species."""
    keys = history.where(F.col("species_pk").isNotNull()).groupBy(
        normalize_species(F.col("species_normalized"), "full").alias("_key")
    ).agg(F.max("species_pk").alias("_pk"))
    by_full = keys.select(F.col("_key").alias("_full"), F.col("_pk").alias("_by_full"))
    by_two = keys.select(F.col("_key").alias("_two"), F.col("_pk").alias("_by_two"))
    named = manifest.withColumn("_full", normalize_species(F.col("organism_name"), "full")).withColumn(
        "_two", normalize_species(F.col("organism_name"), "full_key")
    )
    joined = named.join(by_full, "_full", "left").join(by_two, "_two", "left")
    rows = joined.select(
        "accession", F.col("_full").alias("species_ncbi"), F.coalesce("_by_full", "_by_two").alias("species_pk"), "is_current", "row_idx"
    )
    return assign_pk(rows, ["row_idx"], "genome_pk").drop("row_idx")


def map_labels(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Label to analysis species: by accession in the manifest, else by name.

    ``df`` has ``label, row_idx``; ``manifest`` has ``accession, species_label,
    row_idx``, first row per accession.
    """
    found = extract_accession(F.col("accession"))
    named = manifest.select(
        found.alias("accession"), normalize_species(F.col("species_label"), "binomial_lower").alias("_species"), "row_idx"
    ).where(F.col("accession").isNotNull() & (F.col("_species") != UNKNOWN))
    first = dedupe_first(named, ["accession"], ["row_idx"]).drop("row_idx")
    return (
        df.withColumn("accession", extract_accession(F.col("label")))
        .join(first, "accession", "left")
        .withColumn("mapped_species", F.coalesce("_species", normalize_species(F.col("label"), "binomial_lower")))
        .withColumn(
            "mapping_source", F.when(F.col("_species").isNotNull(), "manifest_accession").otherwise("normalized_label")
        )
        .drop("_species")
    )


def unmapped_labels(mapped: DataFrame) -> DataFrame:
    return mapped.where(F.col("mapped_species").isNull() | F.col("mapped_species").isin("", UNKNOWN))


def duplicate_labels(mapped: DataFrame) -> DataFrame:
    """All but the first label of each species."""
    known = mapped.where(~F.col("mapped_species").isin("", UNKNOWN))
    first = known.groupBy("mapped_species").agg(F.min("row_idx").alias("row_idx"))
    return known.join(first, ["mapped_species", "row_idx"], "left_anti")


def resolve_labels(left: DataFrame, right: DataFrame, substring: bool = False) -> DataFrame:
    """Resolve labels in tiers: same normal form, same species key, one inside the other.

    ``left`` has ``label``; ``right`` has ``label, row_idx``. The first
    candidate by ``row_idx`` is taken; more than one makes the match ambiguous.
    The substring tier looks each text up by its rarest 3-gram (`containing`),
    in both directions, so it needs no pairwise comparison.
    """
    lefts = left.select("label").distinct().select(
        "label", normalize_species(F.col("label"), "label").alias("norm"), normalize_species(F.col("label"), "label_key").alias("key")
    )
    rights = right.select(
        F.col("label").alias("candidate"),
        "row_idx",
        normalize_species(F.col("label"), "label").alias("norm"),
        normalize_species(F.col("label"), "label_key").alias("key"),
    )

    def best(on: str, tier: str) -> DataFrame:
        rows = rights.where(F.col(on) != "") if on == "key" else rights
        return _first_candidate(rows, [on]).withColumnRenamed("_first", f"_{tier}").withColumnRenamed("_n", f"_{tier}_n")

    out = lefts.join(best("norm", "exact"), "norm", "left").join(best("key", "species"), "key", "left")
    tiers = [("exact", "exact_normalized"), ("species", "species_key")]
    if substring:
        out = stored(out)
        open_rows = out.where(F.col("_exact").isNull() & F.col("_species").isNull() & (F.col("norm") != "")).select("label", "norm")
        # Candidates are reduced to the first and their number per normal form
        # before they are looked up.
        by_norm = stored(_first_candidate(rights.where("norm <> ''"), ["norm"]))
        norms = open_rows.select("norm").distinct()
        inside = containing(by_norm.select(F.col("norm").alias("part")), norms.select(F.col("norm").alias("whole")))
        inside = inside.join(by_norm.withColumnRenamed("norm", "part"), "part").select(F.col("whole").alias("norm"), "_first", "_n")
        around = containing(norms.select(F.col("norm").alias("part")), by_norm.select(F.col("norm").alias("whole")))
        around = around.join(by_norm.withColumnRenamed("norm", "whole"), "whole").select(F.col("part").alias("norm"), "_first", "_n")
        # An open label equals no normal form, so no candidate is in both.
        found = inside.unionByName(around).groupBy("norm").agg(F.min("_first").alias("_sub"), F.sum("_n").alias("_sub_n"))
        found = open_rows.join(found, "norm").select("label", "_sub", "_sub_n")
        out = out.join(found, "label", "left")
        tiers.append(("sub", "substring_normalized"))
    method = F.lit("unmatched")
    resolved: Column = F.lit(None).cast("string")
    count: Column = F.lit(0).cast("bigint")
    for tier, name in reversed(tiers):
        hit, many = F.col(f"_{tier}").isNotNull(), F.col(f"_{tier}_n") > 1
        method = F.when(hit & many, name + "_ambiguous").when(hit, name).otherwise(method)
        resolved = F.when(hit, F.col(f"_{tier}.candidate")).otherwise(resolved)
        count = F.when(hit, F.col(f"_{tier}_n")).otherwise(count)
    return out.select("label", resolved.alias("resolved"), method.alias("match_method"), count.alias("n_candidates"))


def _first_candidate(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(F.struct("row_idx", "candidate")).alias("_first"), F.count(F.lit(1)).alias("_n"))


def _grams(df: DataFrame, column: str, width: int) -> DataFrame:
    """Each place (from 1) of a text with the ``width`` characters from there."""
    found = F.expr(
        f"transform(sequence(1, length({column}) - {width} + 1), i -> named_struct('place', i, 'gram', substring({column}, i, {width})))"
    )
    return df.where(F.length(column) >= width).select(column, F.explode(found).alias("g")).select(column, "g.place", "g.gram")


def containing(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) for every text of ``part`` that lies inside one of ``whole``, each pair once.

    A part is known by its rarest 3-gram among the wholes, one of fewer than
    three characters by itself. A place of such a gram in a whole gives one
    piece per distinct (offset, length) that parts have around it, and pieces
    meet parts by equality. So a gram that many parts and many wholes share
    costs its places times its shapes, never parts times wholes. Empty and NULL
    texts lie in nothing.
    """
    parts, wholes = stored(parts.select("part").distinct()), stored(wholes.select("whole").distinct())
    frequent = _grams(wholes, "whole", 3).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        _grams(parts, "part", 3).join(frequent, "gram", "left").groupBy("part")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "place")).alias("g"))
        .where("g.n > 0").select("part", "g.gram", "g.place")
    )
    short = parts.where("length(part) BETWEEN 1 AND 2").select("part", F.col("part").alias("gram"), F.lit(1).alias("place"))
    known = stored(rarest.unionByName(short))
    shapes = known.select("gram", F.col("place").alias("offset"), F.length("part").alias("size")).distinct()
    places = reduce(DataFrame.unionByName, [_grams(wholes, "whole", width) for width in (1, 2, 3)])
    pieces = (
        places.join(shapes, "gram")
        .where("place >= offset AND place - offset + size <= length(whole)")
        .select(F.expr("substring(whole, place - offset + 1, size)").alias("part"), "whole")
    )
    return pieces.distinct().join(known.select("part"), "part", "left_semi")


def candidates_of(left: DataFrame, right: DataFrame, tier: str = "label_key") -> DataFrame:
    """Candidates per key for the ambiguity report, for keys that labels ask for."""
    asked = left.select(normalize_species(F.col("label"), tier).alias("key")).distinct()
    rows = right.select(normalize_species(F.col("label"), tier).alias("key"), F.col("label").alias("candidate"), "row_idx")
    return rows.join(asked, "key", "left_semi")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key with where it occurs: both, only the first, only the second."""
    x = a.select(key).distinct().withColumn("_a", F.lit(True))
    y = b.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_first").otherwise("only_second")
    return x.join(y, key, "full").select(key, side.alias("side"))
