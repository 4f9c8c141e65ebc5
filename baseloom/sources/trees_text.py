"""Tree texts, likelihood texts, node relations and distances as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baseloom.functions.names import coerce_node, normalize_species
from baseloom.operators.ranking import assign_pk
from baseloom.operators.validate import pick_column

# Annotated tree labels, log lines and numbers.
GC_LABEL = r"([^\(\):,\s]+).(\d+\.\d+):"
LOG_LINE = r"^>Node\s+(\d+),\s+son of Node\s+(\d+)\s+by branch of length\s+([0-9.eE+-]+)"
NUMBER = r"[-+]?\d*\.\d+|[-+]?\d+"
# Column names of children, parents and distances.
CHILD_NAMES = ["daughter", "daughter_node", "child", "child_node", "node", "node_id", "descendant", "descendant_node", "son", "son_node"]
PARENT_NAMES = ["parent", "parent_node", "ancestor", "ancestor_node", "mother", "parent_id"]
DISTANCE_CHILD = ["node_or_species", "child", "daughter", "node"]
DISTANCE_NAMES = ["dij", "d_ij", "distance", "branch_length"]


def parse_gc_trees(trees: DataFrame, n_species: int) -> DataFrame:
    """(ortholog, node, gc) of annotated trees, from ``ortholog, text``.

    A label with a space before the value is a tip, one with ``)`` an internal
    node; internal nodes are numbered in text order from ``n_species + 1``.
    Trees without any value give no row; `empty_trees` lists them.
    """
    pattern = F.lit(GC_LABEL)
    found = F.arrays_zip(
        F.regexp_extract_all("text", pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all("text", pattern, F.lit(1)).alias("label"),
        F.regexp_extract_all("text", pattern, F.lit(2)).alias("value"),
    )
    kept = F.filter(found, lambda m: m["whole"].contains(" ") | m["whole"].contains(")"))
    rows = trees.select("ortholog", F.posexplode(kept).alias("pos", "m"))
    tip = F.col("m.whole").contains(" ")
    # The rows of one tree are numbered by one running count, in time linear in the tree.
    upto = Window.partitionBy("ortholog").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    internal = F.count(F.when(~tip, 1)).over(upto)
    node = F.when(tip, normalize_species(F.col("m.label"), "binomial_lower")).otherwise(
        F.concat(F.lit("node_"), (internal + n_species).cast("string"))
    )
    return rows.select("ortholog", F.col("pos").cast("bigint").alias("pos"), node.alias("node"), F.col("m.value").cast("double").alias("gc"))


def empty_trees(trees: DataFrame) -> DataFrame:
    """Orthologs whose tree text holds no value."""
    whole = F.regexp_extract_all("text", F.lit(GC_LABEL), F.lit(0))
    usable = F.size(F.filter(whole, lambda m: m.contains(" ") | m.contains(")")))
    return trees.where(usable == 0).select("ortholog")


def parse_ancestral_gc(texts: DataFrame) -> DataFrame:
    """Ancestral GC per ortholog: the last number of the first ``Ancestral`` line with
    a number, as a percentage. From ``ortholog, text``."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.contains("Ancestral") & x.rlike(NUMBER))
    value = F.element_at(F.regexp_extract_all(F.get(lines, F.lit(0)), F.lit(NUMBER), F.lit(0)), -1).cast("double")
    rows = texts.select("ortholog", value.alias("_v"))
    return rows.where("_v IS NOT NULL").select(
        "ortholog", F.when(F.col("_v") <= 1, F.col("_v") * 100).otherwise(F.col("_v")).alias("gc")
    )


def pair_ortholog_files(trees: DataFrame, likelihoods: DataFrame, tree_suffix: str, lk_suffix: str, strict: bool = False) -> DataFrame:
    """Tree and likelihood texts of the orthologs that have both, from ``name, text``.

    With ``strict`` an ortholog without its pair is an error.
    """

    def keyed(df: DataFrame, suffix: str, text: str) -> DataFrame:
        stem = F.left("name", F.length("name") - len(suffix))
        return df.where(F.col("name").endswith(suffix)).select(stem.alias("ortholog"), F.col("text").alias(text))

    left, right = keyed(trees, tree_suffix, "tree_text"), keyed(likelihoods, lk_suffix, "lk_text")
    if strict:
        lost = unpaired_orthologs(left, right).limit(10).collect()
        if lost:
            raise ValueError("unpaired: " + ", ".join(f"{r['ortholog']} ({r['missing']})" for r in lost))
    return left.join(right, "ortholog")


def unpaired_orthologs(left: DataFrame, right: DataFrame) -> DataFrame:
    no_right = left.join(right, "ortholog", "left_anti").select("ortholog", F.lit("likelihood").alias("missing"))
    return no_right.unionByName(right.join(left, "ortholog", "left_anti").select("ortholog", F.lit("tree").alias("missing")))


def node_edges(df: DataFrame) -> DataFrame:
    """Edges of a long table (child and parent columns) or a wide one (a column per child)."""
    child = pick_column(df, CHILD_NAMES, required=False)
    parent = pick_column(df, PARENT_NAMES, required=False)
    if child and parent and child != parent:
        rows = df.select(F.col(child).alias("child"), F.col(parent).alias("parent"))
    else:
        rows = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "child", "parent")
    return _coerced(rows)


def wide_edges(pieces: DataFrame) -> DataFrame:
    """Edges of a wide table's text pieces (line, piece, value), as ``sinks.edges_wide`` makes them."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.col("value")), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = lambda c: F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    plain = F.transform(cells, lambda c: F.when(c.startswith('"'), bare(c)).otherwise(c))
    pairs = pieces.groupBy("piece").agg(*[F.max(F.when(F.col("line") == i, plain)).alias(n) for i, n in enumerate(("child", "parent"))])
    return _coerced(pairs.select(F.explode(F.arrays_zip("child", "parent")).alias("e")).select("e.child", "e.parent"))


def _coerced(rows: DataFrame) -> DataFrame:
    edges = rows.select(coerce_node(F.col("child")).alias("child"), coerce_node(F.col("parent")).alias("parent"))
    return edges.where("child <> '' AND parent <> ''").distinct()


def parse_compout(lines: DataFrame) -> DataFrame:
    """Edges of internal nodes from log lines (``tree_id, value``).

    The line whose node is its own parent names the root; children of the root
    get the parent ``ancestral``.
    """
    line = F.trim("value")
    rows = lines.where(line.rlike(LOG_LINE)).select(
        "tree_id",
        F.regexp_extract(line, LOG_LINE, 1).cast("bigint").alias("c"),
        F.regexp_extract(line, LOG_LINE, 2).cast("bigint").alias("p"),
    )
    roots = rows.where("c = p").groupBy("tree_id").agg(F.min("c").alias("_root"))
    parent = F.when(F.col("p") == F.col("_root"), F.lit("ancestral")).otherwise(F.concat(F.lit("node_"), "p"))
    return rows.where("c <> p").join(roots, "tree_id").select(
        "tree_id", F.concat(F.lit("node_"), "c").alias("child"), parent.alias("parent")
    )


def rootless_logs(lines: DataFrame) -> DataFrame:
    """Trees whose log has no root line."""
    line = F.trim("value")
    flags = lines.groupBy("tree_id").agg(
        F.max(F.coalesce(F.regexp_extract(line, LOG_LINE, 1) == F.regexp_extract(line, LOG_LINE, 2), F.lit(False)) & line.rlike(LOG_LINE)).alias("_has")
    )
    return flags.where("NOT _has").select("tree_id")


def distances(df: DataFrame) -> DataFrame:
    """Edge distances of a table with named columns; NULL distances are dropped."""
    child, parent = pick_column(df, DISTANCE_CHILD), pick_column(df, ["parent", "parent_node"])
    value = pick_column(df, DISTANCE_NAMES)
    rows = df.select(
        coerce_node(F.col(child)).alias("child"), coerce_node(F.col(parent)).alias("parent"), F.col(value).cast("string").try_cast("double").alias("dij")
    )
    return rows.where((F.col("child") != "") & F.col("dij").isNotNull() & ~F.isnan("dij"))


def nested_distances(texts: DataFrame) -> DataFrame:
    """Edge distances of nested JSON objects ``{child: {parent: value}}`` in ``value``."""
    outer = texts.select(F.explode(F.from_json("value", "map<string, map<string, double>>")).alias("c", "m"))
    rows = outer.select("c", F.explode("m").alias("p", "dij"))
    return rows.select(coerce_node(F.col("c")).alias("child"), coerce_node(F.col("p")).alias("parent"), "dij").where(
        (F.col("child") != "") & F.col("dij").isNotNull()
    )


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """File order as a number, for first-row rules."""
    return assign_pk(df, order, "row_idx")
