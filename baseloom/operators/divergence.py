"""Composition divergence along a tree, and the master species table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baseloom.functions.names import is_tip, normalize_species
from baseloom.operators.ranking import assign_pk, dedupe_first, limit_per_group
from baseloom.session import stored


def displacements(node_gc: DataFrame, edges: DataFrame) -> DataFrame:
    """Squared GC difference of child and parent, per ortholog that has both."""
    child = node_gc.select("ortholog", F.col("node").alias("child"), F.col("gc").alias("child_gc"))
    parent = node_gc.select("ortholog", F.col("node").alias("parent"), F.col("gc").alias("parent_gc"))
    difference = F.col("child_gc") - F.col("parent_gc")
    return (
        child.join(edges.select("child", "parent").distinct(), "child")
        .join(parent, ["ortholog", "parent"])
        .select(
            "ortholog",
            "child",
            "parent",
            "child_gc",
            "parent_gc",
            difference.alias("difference"),
            (difference * difference).alias("squared_displacement"),
        )
    )


# Nodes of a tree are dealt to blocks of this many: the rows of a block and an ortholog are put out together.
NODE_BLOCK = 256
# A task looks at this many blocks, for at most so many orthologs: few names, so that what is written goes by dictionaries.
BLOCKS_TOGETHER = 16
ORTHOLOGS_TOGETHER = 50_000
# The names of a tree of up to so many nodes are sent to all executors.
NAMES_SENT = 1 << 19


def missing_counts(node_gc: DataFrame, edges: DataFrame) -> DataFrame:
    """Per edge the orthologs without a value for the child, and those with one for it but none for the parent.

    Counted by what is there: orthologs less those that have the child, and
    those that have the child less those that have both. The work is linear in
    the rows of ``node_gc``; no missing pair is formed.
    """
    tree = edges.select("child", "parent").distinct()
    have = node_gc.select("ortholog", "node").distinct()
    total = have.agg(F.countDistinct("ortholog")).scalar()
    child = have.join(tree.withColumnRenamed("child", "node"), "node").select("ortholog", F.col("node").alias("child"), "parent")
    parent = have.select("ortholog", F.col("node").alias("parent"), F.lit(1).alias("_one"))
    counted = child.join(parent, ["ortholog", "parent"], "left").groupBy("child", "parent").agg(
        F.count(F.lit(1)).alias("_child"), F.count("_one").alias("_both")
    )
    counts = tree.join(counted, ["child", "parent"], "left").fillna(0, ["_child", "_both"])
    return counts.select(
        "child",
        "parent",
        (total - F.col("_child")).cast("bigint").alias("n_child_missing"),
        (F.col("_child") - F.col("_both")).cast("bigint").alias("n_parent_missing"),
    )


def missing_nodes(node_gc: DataFrame, edges: DataFrame) -> DataFrame:
    """(ortholog, node) for the tree's nodes that an ortholog has no value for.

    Nodes are numbered, and what is missing are the gaps between the numbers an ortholog has: only rows that are there
    move, and one narrow row per ortholog and `BLOCKS_TOGETHER` blocks.
    """
    tree = edges.select("child", "parent").distinct()
    return _absent(node_gc, tree.select(F.col("child").alias("node")).union(tree.select("parent"))).select("ortholog", "node")


def _absent(node_gc: DataFrame, names: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(ortholog, node, parent) for the given nodes that an ortholog has no value for, and then ``parent`` is NULL.

    With ``tree`` (child, parent) also the children that are there, with each parent that is not. A row that is there is
    an event at its own number and one at the number of each parent, which asks whether there is a row before it. Events
    move once, to tasks of few blocks and few orthologs; gaps become rows after the last exchange, block by block.
    """
    known = names.select("node", F.lit(0).alias("_beside"))
    if tree is not None:
        known = known.union(tree.select("parent", F.lit(1)))
    known = known.where("node IS NOT NULL").groupBy("node").agg(F.min("_beside").alias("_beside"))
    nodes = assign_pk(known, ["_beside", "node"], "_at", 0)
    orthologs = node_gc.select("ortholog").distinct()
    n_nodes, end, n_orthologs = nodes.count(), nodes.where("_beside = 0").count(), orthologs.count()
    size = NODE_BLOCK * BLOCKS_TOGETHER
    groups, beside = -(-end // size), -(-(n_nodes - end) // size)
    # Parents that are no wanted nodes have groups of their own.
    nodes = nodes.select("node", (F.col("_at") + F.col("_beside") * (groups * size - end)).alias("_at"))
    tasks = int(node_gc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(-(-n_orthologs // ORTHOLOGS_TOGETHER), -(-tasks // max(1, groups)))
    sent = F.broadcast if n_nodes <= NAMES_SENT else lambda df: df

    none = F.lit(None).cast("bigint")
    events = nodes.select("node", "_at", none.alias("_from"))
    if tree is not None:
        child, parent = nodes.toDF("child", "_from"), nodes.toDF("parent", "_at")
        asked = tree.join(child, "child").join(parent, "parent")
        events = events.unionByName(asked.select(F.col("child").alias("node"), "_at", "_from"))
    events = events.groupBy("node").agg(F.collect_list(F.struct("_at", "_from")).alias("_events"))
    there = (
        node_gc.where("ortholog IS NOT NULL").join(sent(events), "node")
        .select("ortholog", F.inline("_events")).withColumn("_group", F.expr(f"_at div {size}"))
    )
    every = orthologs.where(F.lit(groups > 0)).select(
        "ortholog", none.alias("_at"), none.alias("_from"), F.explode(F.expr(f"sequence(0L, {max(1, groups) - 1}L)")).alias("_group")
    )
    share = F.pmod(F.xxhash64("ortholog"), F.lit(shares))
    dealt = (
        there.unionByName(every)
        .select((F.col("_group") * shares + share).cast("int").alias("_deal"), "ortholog", "_at", "_from")
        .repartitionById(max(1, (groups + beside) * shares), F.col("_deal"))
        .distinct()
    )

    # An event without a number closes the blocks of its group.
    first = F.expr(f"_deal div {shares} * {BLOCKS_TOGETHER}")
    last = F.least(first + (BLOCKS_TOGETHER - 1), F.lit((end - 1) // NODE_BLOCK).cast("bigint"))
    block = F.expr(f"_at div {NODE_BLOCK}")
    placed = dealt.select(
        "_deal", "ortholog", "_at", "_from", F.explode(F.when(F.col("_at").isNull(), F.sequence(first, last)).otherwise(F.array(block))).alias("_block")
    ).withColumn("_at", F.coalesce("_at", F.least((F.col("_block") + 1) * NODE_BLOCK, F.lit(end))))
    before = Window.partitionBy("_deal", "_block", "ortholog").orderBy("_at", "_from").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("_from").isNull(), F.col("_at"))).over(before)
    asks = F.col("_from").isNotNull()
    low = F.when(asks, F.col("_from")).otherwise(F.coalesce(F.col("_seen") + 1, F.col("_block") * NODE_BLOCK))
    high = F.when(asks, F.col("_from")).otherwise(F.col("_at") - 1)
    lost = F.when(asks, F.coalesce(F.col("_seen") != F.col("_at"), F.lit(True))).otherwise((F.col("_at") <= end) & (high >= low))
    gaps = placed.withColumn("_seen", seen).where(lost).select(
        "ortholog", "_at", "_from", low.alias("_low"), high.alias("_high"), F.col("_block").alias("_over"), F.expr(f"coalesce(_from div {NODE_BLOCK}, _block)").alias("_block")
    )
    named = nodes.groupBy(F.expr(f"_at div {NODE_BLOCK}").alias("_block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "node"))), lambda n: n["node"]).alias("_names")
    )
    found = gaps.join(sent(named), "_block")
    parent = F.lit(None).cast("string")
    if tree is not None:
        found = found.join(sent(named.toDF("_over", "_parents")), "_over")
        parent = F.when(F.col("_from").isNotNull(), F.get("_parents", F.expr(f"int(_at % {NODE_BLOCK})")))
    some = F.slice("_names", F.expr(f"int(_low % {NODE_BLOCK}) + 1"), F.expr("int(_high - _low) + 1"))
    return found.select("ortholog", F.explode(some).alias("node"), parent.alias("parent"))


def missing_pairs(node_gc: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges an ortholog has no value for: the child is missing, else the parent.

    `missing_counts` sums them up without forming them. A missing child is formed once, from the gaps of
    `missing_nodes`, and neither stored nor shuffled; a missing parent is sought only for children that are there.
    """
    tree = edges.select("child", "parent").distinct()
    upward = tree.where("parent IS NOT NULL")
    found = _absent(node_gc, tree.select(F.col("child").alias("node")), upward.where("child IS NOT NULL"))
    pairs = found.select("ortholog", F.col("node").alias("child"), "parent")
    half = []
    # An edge without a child lacks its parent alone; an unnamed ortholog has no value for any node.
    nameless = upward.where("child IS NULL")
    if not nameless.isEmpty():
        lost = _absent(node_gc.where("ortholog IS NOT NULL"), nameless.select(F.col("parent").alias("node")))
        half.append(lost.select("ortholog", F.lit(None).cast("string").alias("child"), F.col("node").alias("parent")))
    unnamed = node_gc.where("ortholog IS NULL").select("ortholog").distinct()
    half.append(unnamed.crossJoin(upward).select("ortholog", "child", "parent"))
    for more in half:
        pairs = pairs.unionByName(more)
    reason = F.when(F.col("parent").isNull(), "CHILD_MISSING").otherwise(F.concat(F.lit("PARENT_MISSING:"), "parent"))
    return pairs.select("ortholog", "child", reason.alias("reason"))


def require_complete(node_gc: DataFrame, edges: DataFrame, shown: int = 10) -> None:
    """Strict form: stop with the first missing pairs."""
    first = missing_pairs(node_gc, edges).orderBy("ortholog", "child").limit(shown).collect()
    if first:
        raise KeyError("; ".join(f"{r['ortholog']} {r['child']} {r['reason']}" for r in first))


def dij(node_gc: DataFrame, edges: DataFrame) -> DataFrame:
    """Root of the summed squared displacement per edge; NULL without a pair."""
    summed = displacements(node_gc, edges).groupBy("child", "parent").agg(
        F.sqrt(F.sum("squared_displacement")).alias("dij")
    )
    return edges.select("child", "parent").distinct().join(summed, ["child", "parent"], "left")


def dianc(node_gc: DataFrame) -> DataFrame:
    """Root of the summed squared distance of each tip to the ancestor."""
    root = node_gc.where(F.col("node") == "ancestral").select("ortholog", F.col("gc").alias("root_gc"))
    distance = F.col("gc") - F.col("root_gc")
    return (
        node_gc.where(is_tip(F.col("node")))
        .join(root, "ortholog")
        .groupBy(F.col("node").alias("genus_species"))
        .agg(F.sqrt(F.sum(distance * distance)).alias("dianc"))
    )


def gc3_summary(node_gc: DataFrame) -> DataFrame:
    """Mean, sample spread (NULL for one value) and number of orthologs per node."""
    return node_gc.groupBy(F.col("node").alias("node_or_species")).agg(
        F.avg("gc").alias("mean_gc3"), F.stddev_samp("gc").alias("sd_gc3"), F.count("gc").alias("n_orthologs")
    )


def displacement_examples(disp: DataFrame, order: list[str], genus: str, kept: int = 200) -> DataFrame:
    """Worked examples from the first 200: three of the highest internal node and
    three of a genus; six of all if neither occurs."""
    # The sample has a fixed size of `kept` rows.
    first = disp.orderBy(*order).limit(kept)
    number = F.regexp_extract("child", r"^node_(\d+)", 1).try_cast("bigint")
    numbered = first.withColumn("_number", number)
    highest = numbered.agg(F.max("_number")).scalar()
    mine = F.lower("child").startswith(genus.lower() + "_")
    inner = limit_per_group(numbered.where(F.col("_number") == highest).withColumn("_g", F.lit(1)), ["_g"], order, 3)
    named = limit_per_group(numbered.where(mine).withColumn("_g", F.lit(1)), ["_g"], order, 3)
    chosen = inner.unionByName(named).dropDuplicates(["ortholog", "child", "parent"])
    found = numbered.agg(F.count_if(F.col("_number").isNotNull() | mine)).scalar()
    fallback = limit_per_group(numbered.where(found == 0).withColumn("_g", F.lit(1)), ["_g"], order, 6)
    return chosen.unionByName(fallback).drop("_number", "_g")


def species_metadata(*sources: DataFrame) -> DataFrame:
    """Accession and names per species; rows with an accession come first, then source order.

    Each source has ``accession, organism_name, species_label, row_idx``.
    """
    parts = []
    for place, source in enumerate(sources):
        key = normalize_species(F.col("species_label"), "binomial_lower")
        parts.append(
            source.select(
                key.alias("genus_species"),
                "organism_name",
                "accession",
                F.lit(place).alias("_source"),
                F.col("row_idx").alias("_row"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.where((F.col("genus_species") != "unknown_species") & (F.col("genus_species") != ""))
    first = dedupe_first(rows, ["_source", "genus_species"], ["_row"])
    blank = F.col("accession").isNull() | F.col("accession").isin("", "nan", "None")
    best = dedupe_first(first.withColumn("_blank", blank.cast("int")), ["genus_species"], ["_blank", "_source"])
    return best.withColumn("manifest_merge_key", F.col("genus_species")).drop("_blank", "_source", "_row")


def master_table(
    gc3: DataFrame, ancestor: DataFrame, gc4: DataFrame, metadata: DataFrame, all_species: bool = False
) -> DataFrame:
    """GC3, distance to the ancestor, GC4 and accession per species.

    With ``all_species`` every species of the metadata is kept.
    """
    tips = gc3.where(is_tip(F.col("node_or_species"))).withColumn(
        "genus_species", normalize_species(F.col("node_or_species"), "binomial_lower")
    )
    values = (
        tips.select("genus_species", "mean_gc3", "sd_gc3", "n_orthologs")
        .join(ancestor, "genus_species", "left")
        .join(gc4.select("genus_species", "mean_gc4", "sd_gc4"), "genus_species", "left")
    )
    names = metadata.select("genus_species", "accession", "manifest_merge_key")
    joined = names.join(values, "genus_species", "left" if all_species else "right")

    def known(name: str) -> Column:
        return F.when(~F.col(name).isin("nan", "None", ""), F.col(name)).alias(name)

    return joined.select(
        "genus_species",
        known("accession"),
        "mean_gc3",
        "sd_gc3",
        "n_orthologs",
        "mean_gc4",
        "sd_gc4",
        "dianc",
        known("manifest_merge_key"),
    )


def count_mismatches(gc3: DataFrame, gc4: DataFrame) -> DataFrame:
    """Species whose GC3 and GC4 ortholog counts differ."""
    left = gc3.select(F.col("node_or_species").alias("genus_species"), "n_orthologs")
    return left.join(gc4.select("genus_species", "n_gc4_values"), "genus_species").where(
        F.col("n_orthologs") != F.col("n_gc4_values")
    )


def master_table_wide(
    master: DataFrame, sizes: DataFrame, mass: DataFrame, thermal: DataFrame, key: str = "genus_species"
) -> DataFrame:
    """The master table with trait tables, each reduced to one row per species.

    Columns two inputs share are filled from the left one first.
    """
    out = master
    for right in (sizes, mass, thermal):
        one = right.groupBy(key).agg(
            *[F.min(F.when(F.col(c).isNotNull(), F.struct("row_idx", c))).getField(c).alias(c) for c in right.columns if c not in (key, "row_idx")]
        )
        shared = [c for c in one.columns if c in out.columns and c != key]
        renamed = one.select(*[F.col(c).alias(f"{c}__r") if c in shared else F.col(c) for c in one.columns])
        out = out.join(renamed, key, "left")
        for c in shared:
            out = out.withColumn(c, F.coalesce(c, f"{c}__r")).drop(f"{c}__r")
    return out


def merge_diagnostics(master: DataFrame, gc3: DataFrame, metadata: DataFrame, columns: list[str]) -> DataFrame:
    """Metric and value rows: counts of the master table and set differences."""
    counts = master.agg(
        F.count(F.lit(1)).alias("rows_in_output"), *[F.count(c).alias(f"rows_with_{c}") for c in columns]
    )
    names = ["rows_in_output", *[f"rows_with_{c}" for c in columns]]
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("diagnostic"), F.col(n).alias("value")) for n in names])))
    tips = gc3.where(is_tip(F.col("node_or_species"))).select(F.col("node_or_species").alias("genus_species")).distinct()
    meta = metadata.select("genus_species").distinct()
    sets = {
        "species_with_gc3_results": tips,
        "species_in_metadata": meta,
        "gc_species_missing_from_metadata": tips.join(meta, "genus_species", "left_anti"),
        "metadata_species_missing_gc_results": meta.join(tips, "genus_species", "left_anti"),
    }
    for name, df in sets.items():
        rows = rows.unionByName(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("diagnostic"), "value"))
    return rows


def merge_report(master: DataFrame, inputs: dict[str, tuple[DataFrame, str | None]], key: str = "genus_species") -> DataFrame:
    """Per species: is it in each input, and has it a value there.

    ``inputs`` maps a label to its table and, if any, its value column.
    """
    report = master.select(key).distinct()
    for label, (df, value) in inputs.items():
        has_value = F.lit(True) if value is None else F.col(value).isNotNull()
        flags = df.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.lit(True).alias(f"present_in_{label}"), F.bool_or(has_value).alias(f"has_{label}_value")
        )
        report = report.join(flags, key, "left").fillna(False, [f"present_in_{label}", f"has_{label}_value"])
    return report


def edge_plot_table(edges: DataFrame, distances: DataFrame, gc: DataFrame) -> DataFrame:
    """Edges with divergence as branch length and GC of both ends.

    An edge without distance gets 5 % of the smallest one (of 1 if there is
    none). The first row counts when a child occurs twice.
    """
    one = distances.groupBy("child").agg(F.min(F.struct("row_idx", "dij")).getField("dij").alias("dij"))
    values = gc.select(F.col("node").alias("child"), F.col("gc").alias("child_gc3"))
    parents = gc.select(F.col("node").alias("parent"), F.col("gc").alias("parent_gc3"))
    joined = edges.select("child", "parent").join(one, "child", "left")
    smallest = joined.agg(F.coalesce(F.min("dij"), F.lit(1.0))).scalar()
    return (
        joined.withColumn("dij_branch_length", F.coalesce("dij", smallest * 0.05))
        .join(values, "child", "left")
        .join(parents, "parent", "left")
        .select("child", "parent", "dij_branch_length", "parent_gc3", "child_gc3", F.col("dij").isNull().alias("filled"))
    )


def match_diagnostics(edges: DataFrame, distances: DataFrame, gc: DataFrame) -> DataFrame:
    """Matched and total edge ends for each value table, and duplicate child keys."""
    has_d = distances.where(F.col("dij").isNotNull()).select("child", F.lit(1).alias("_d")).distinct()
    has_c = gc.select(F.col("node").alias("child"), F.lit(1).alias("_c")).distinct()
    has_p = gc.select(F.col("node").alias("parent"), F.lit(1).alias("_p")).distinct()
    joined = edges.select("child", "parent").join(has_d, "child", "left").join(has_c, "child", "left").join(has_p, "parent", "left")
    total = F.count(F.lit(1))
    counted = joined.agg(
        F.struct(F.lit("child_dij").alias("check"), F.count("_d").alias("matched"), total.alias("total")).alias("a"),
        F.struct(F.lit("child_gc").alias("check"), F.count("_c").alias("matched"), total.alias("total")).alias("b"),
        F.struct(F.lit("parent_gc").alias("check"), F.count("_p").alias("matched"), total.alias("total")).alias("c"),
    ).select(F.inline(F.array("a", "b", "c")))
    doubled = distances.groupBy("child").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(
        doubled.agg(F.count_if(F.col("n") > 1).alias("matched"), F.count(F.lit(1)).alias("total")).select(
            F.lit("duplicate_dij_child").alias("check"), "matched", "total"
        )
    )


def unmatched_ends(edges: DataFrame, distances: DataFrame, gc: DataFrame) -> DataFrame:
    """The edge ends without a value."""
    no_d = edges.join(distances.where(F.col("dij").isNotNull()), "child", "left_anti").select(
        F.lit("child_dij").alias("check"), F.col("child").alias("node")
    )
    nodes = gc.select("node")
    no_c = edges.select(F.col("child").alias("node")).join(nodes, "node", "left_anti").select(F.lit("child_gc").alias("check"), "node")
    no_p = edges.select(F.col("parent").alias("node")).join(nodes, "node", "left_anti").select(F.lit("parent_gc").alias("check"), "node")
    return no_d.unionByName(no_c).unionByName(no_p).distinct()


def ancestral_gc(likelihoods: DataFrame, summary: DataFrame) -> DataFrame:
    """Mean ancestral GC over likelihood files, else the summary's ancestral row."""
    fallback = summary.where(F.col("node_or_species") == "ancestral").agg(F.max("mean_gc3")).scalar()
    return likelihoods.agg(
        F.avg("gc").alias("mean_gc"), F.min("gc").alias("min_gc"), F.max("gc").alias("max_gc"), F.count("gc").alias("n_files")
    ).withColumn("ancestral_gc", F.coalesce("mean_gc", fallback))


