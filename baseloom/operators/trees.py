"""Tree operators: descendants, node matching, Newick text over tables of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.functions.names import is_internal
from baseloom.operators.tree_labels import interval_labels, tip_signatures, tips_below
from baseloom.session import cut_lineage, stored


def ancestor_pairs(edges: DataFrame) -> DataFrame:
    """All (node, ancestor, distance) pairs of an edge table with ``child, parent``.

    Paths double in length each round, so a tree of depth d needs log2(d)
    rounds. Each round is checkpointed, which keeps the plan short. A node that
    is its own ancestor is an error.
    """
    pairs = cut_lineage(
        edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("distance")).distinct()
    )
    reach = 1
    while True:
        # Paths of up to twice the reach so far: a cycle shows as soon as they go round it.
        if loop := pairs.where("node = ancestor").select("node").head(1):
            raise ValueError(f"node {loop[0]['node']!r} is its own ancestor")
        step = pairs.where(F.col("distance") == reach).select(F.col("node").alias("_n"), F.col("ancestor").alias("_mid"))
        longer = step.join(pairs, F.col("_mid") == F.col("node")).select(
            F.col("_n").alias("node"), "ancestor", (F.col("distance") + reach).alias("distance")
        )
        longer = cut_lineage(longer)
        if longer.isEmpty():
            return pairs
        pairs = cut_lineage(pairs.unionByName(longer))
        reach *= 2


def descendant_tips(edges: DataFrame) -> DataFrame:
    """Each internal node (and the root) with its tips, one row per pair, by ranges of interval labels."""
    return tips_below(interval_labels(edges))


def match_nodes(edges_a: DataFrame, edges_b: DataFrame) -> DataFrame:
    """Nodes of two trees that have the same descendant tips; subtree sums stand for the sets, no pair of node and tip is built."""
    a = tip_signatures(interval_labels(edges_a)).withColumnRenamed("node", "node_a")
    b = tip_signatures(interval_labels(edges_b)).select(F.col("node").alias("node_b"), "signature")
    return a.join(b, "signature", "left").drop("signature")


def lineage(ids: DataFrame, nodes: DataFrame, deepest: int = 200) -> DataFrame:
    """Ranked ancestors per taxon id as columns.

    ``nodes`` has ``tax_id, parent_id, rank, name``. The class is reported as
    ``superorder``, as the catalogue's schema has it. A recursive query walks
    from the wanted ids upward, one join per level, so the work is that of
    their lineages, whatever the size of the taxonomy. A lineage of more than
    ``deepest`` levels is an error, and so is a cycle.
    """
    # Taxonomic ranks and their catalogue columns.
    ranks = {"phylum": "phylum", "class": "superorder", "order": "order", "family": "family", "genus": "genus", "species": "genus_species"}
    wanted = ids.select("tax_id").where("tax_id IS NOT NULL").distinct()
    links = nodes.where("tax_id <> parent_id").select(F.col("tax_id").alias("child"), F.col("parent_id").alias("parent"))
    above = _walk_up(wanted, links, deepest)
    ranked = nodes.where(F.col("rank").isin(list(ranks))).select(F.col("tax_id").alias("at"), "rank", "name")
    columns = [F.max(F.when(F.col("rank") == r, F.col("name"))).alias(c) for r, c in ranks.items()]
    named = above.join(ranked, "at").groupBy("tax_id").agg(*columns)
    return ids.join(named, "tax_id", "left").fillna("", list(ranks.values()))


def _walk_up(wanted: DataFrame, links: DataFrame, deepest: int) -> DataFrame:
    """(tax_id, at): each wanted id with itself and all its ancestors."""
    spark = wanted.sparkSession
    # The rows are as many as the lineages have levels; Spark's own limit of rows would end a large request.
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return stored(
            spark.sql(
                f"""WITH RECURSIVE up(tax_id, at) MAX RECURSION LEVEL {int(deepest)} AS (
                  SELECT tax_id, tax_id FROM {{wanted}} UNION ALL
                  SELECT up.tax_id, l.parent FROM up JOIN {{links}} l ON l.child = up.at)
                SELECT tax_id, at FROM up""",
                wanted=wanted,
                links=links,
            )
        )
    finally:
        spark.conf.set(limit, before)


def strip_support(newick: Column) -> Column:
    """Drop numeric labels right after a closing bracket."""
    return F.regexp_replace(newick, r"\)(\d+(\.\d+)?([eE][-+]?\d+)?)(?=[:),;])", ")")


def strip_lengths(newick: Column) -> Column:
    return F.regexp_replace(newick, r":-?\d+(\.\d+)?([eE][-+]?\d+)?", "")


@F.udtf(
    returnType="place int, token string, label boolean, node string, parent string, tip boolean, support string, length string"
)
class newick_tokens:
    """Table function: the tokens of a Newick text, in one pass that is linear in its length.

    Tokens are the marks ``( ) , : ;``, single white space characters and the
    runs between them. ``label`` marks a run right after ``( , space``. The
    row of a tip's first run, or of a closing bracket, is a node: it has
    ``node``, its ``parent``, and the texts of ``support`` and ``length``. The
    outermost brackets are ``ancestral``; the other internal nodes are numbered
    in postorder from ``first_id``. Brackets that stay open name no parent; one
    that closes nothing is an error. A NULL text has no tokens.
    """

    def eval(self, newick: str, first_id: int):
        import re

        if newick is None:
            return
        rows, last = [], "("
        # Per open bracket the places of its nodes so far; the lowest level is the text itself.
        levels, node, part, number = [[]], None, "name", int(first_id or 0)
        for place, found in enumerate(re.finditer(r"[(),:;\s]|[^(),:;\s]+", newick, re.ASCII)):
            token = found[0]
            row = [place, token, False, None, None, None, None, None]
            rows.append(row)
            if token == "(":
                levels.append([])
                node, part = None, "name"
            elif token == ")":
                if len(levels) == 1:
                    raise ValueError(f"token {place} of a tree closes a bracket that is not open")
                children, node, part = levels.pop(), row, "support"
                if len(levels) == 1:
                    row[3] = "ancestral"
                else:
                    row[3], number = f"node_{number}", number + 1
                row[5] = False
                for child in children:
                    child[4] = row[3]
                levels[-1].append(row)
            elif token in ",;":
                node, part = None, "name"
            elif token == ":":
                part = "length"
            elif token.isspace():
                if part == "name" and node is not None:
                    node[3] += token
            else:
                row[2] = last in "(," or last.isspace()
                if part == "length" and node is not None:
                    node[7] = (node[7] or "") + token
                elif part == "support":
                    node[6] = (node[6] or "") + token
                elif part == "name" and node is not None:
                    node[3] += token
                elif part == "name":
                    node = row
                    row[3], row[5] = token, True
                    levels[-1].append(row)
            last = token
        for row in rows:
            if row[5]:
                row[3] = row[3].strip()
            yield tuple(row)


def tree_tokens(trees: DataFrame) -> DataFrame:
    """Tokens of every tree of a table with ``tree_id, newick`` and, for numbering, ``first_id``.

    In SQL, after ``spark.udtf.register("newick_tokens", newick_tokens)``:
    ``FROM trees, LATERAL newick_tokens(newick, first_id)``.
    """
    first = F.col("first_id") if "first_id" in trees.columns else F.lit(0)
    own = trees.select("tree_id", "newick", first.cast("int").alias("first_id"))
    tokens = own.lateralJoin(newick_tokens(F.col("newick").outer(), F.col("first_id").outer()))
    return tokens.drop("newick", "first_id")


def clean_newick(trees: DataFrame, mapping: DataFrame, keep_lengths: bool = False) -> DataFrame:
    """Replace accession labels by species, drop support values and lengths.

    ``trees`` has ``tree_id, newick``; ``mapping`` has ``accession, species``.
    Labels are looked up by an equi-join, so the mapping may be of any size. A
    label counts between ``( , space`` and ``: ) , ; space``; a number after
    ``:`` is no label.
    """
    tokens = tree_tokens(trees).select("tree_id", "place", "token", "label")
    found = tokens.join(
        mapping.select(F.col("accession").alias("token"), "species"), "token", "left"
    ).withColumn("_new", F.when(F.col("label"), F.col("species")))
    glued = found.groupBy("tree_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", F.coalesce("_new", "token").alias("t")))), lambda x: x["t"]
            ),
            "",
        ).alias("newick"),
        F.count("_new").alias("n_replaced"),
    )
    cleaned = strip_support(F.col("newick"))
    return glued.withColumn("newick", cleaned if keep_lengths else strip_lengths(cleaned))


def newick_nodes(trees: DataFrame) -> DataFrame:
    """Nodes of every tree: name, parent (NULL at the top), whether it is a tip, support and branch length.

    A support or length that is no number is NULL.
    """
    rows = tree_tokens(trees).where("node IS NOT NULL")
    return rows.select(
        F.col("tree_id").cast("string").alias("tree_id"),
        "node",
        "parent",
        "tip",
        F.expr("try_cast(support AS double)").alias("support"),
        F.expr("try_cast(length AS double)").alias("length"),
    )


def newick_edges(trees: DataFrame) -> DataFrame:
    """Edges of every tree of a table, from ``tree_id, newick, first_id``, numbered as by `newick_tokens`."""
    rows = tree_tokens(trees).where("parent IS NOT NULL")
    return rows.select(F.col("tree_id").cast("string").alias("tree_id"), F.col("node").alias("child"), "parent")


def check_internal_count(edges: DataFrame, logged: DataFrame) -> DataFrame:
    """Trees whose numbered internal nodes differ in number from the log's."""
    counted = edges.where(is_internal(F.col("child"))).groupBy("tree_id").agg(F.countDistinct("child").alias("n_tree"))
    listed = logged.groupBy("tree_id").agg(F.countDistinct("child").alias("n_log"))
    return counted.join(listed, "tree_id", "full").fillna(0, ["n_tree", "n_log"]).where("n_tree <> n_log")
