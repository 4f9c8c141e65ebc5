"""Interval labels: random trees against brute force, deep and wide trees, forests, and what is no tree."""

import random

import pytest
from pyspark.sql import functions as F

from baseloom.operators import tree_labels as L
from baseloom.operators import trees as T


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def random_tree(n, seed):
    r = random.Random(seed)
    name = [f"node_{i}" for i in range(n)]
    pairs = [(name[i], name[r.randrange(max(0, i - 6), i)]) for i in range(1, n)]
    inner = {p for _, p in pairs}
    tip = {x: f"genus_{x}" for x in name if x not in inner}
    return [(tip.get(c, c), p) for c, p in pairs]


def below(pairs):
    up = dict(pairs)
    out = {x: set() for p in pairs for x in p}
    for node in up:
        at = node
        while at in up:
            at = up[at]
            out[at].add(node)
    return out


@pytest.mark.parametrize("n, block", [(2, 1 << 16), (40, 4), (300, 16), (300, 1 << 16)])
def test_random_trees(spark, monkeypatch, n, block):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "LEVELS", 3)
    pairs = random_tree(n, n)
    want = below(pairs)
    labels = L.interval_labels(frame(spark, pairs))
    rows = labels.collect()
    assert sorted(x for r in rows for x in (r.enter, r.leave)) == list(range(2 * len(want)))
    assert {r.node: (r.leave - r.enter - 1) // 2 for r in rows} == {k: len(v) for k, v in want.items()}
    assert {(r.node, r.parent) for r in rows if r.parent} == set(pairs)
    tips = {k: {x for x in v if x.startswith("genus")} for k, v in want.items()}
    got = L.tips_below(labels).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(k, x) for k, v in tips.items() for x in v}
    signed = L.tip_signatures(labels).collect()
    assert {r.node: r.n_tips for r in signed} == {k: len(v) for k, v in tips.items() if v}
    groups = {}
    for r in signed:
        groups.setdefault(r.signature, set()).add(frozenset(tips[r.node]))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({frozenset(v) for v in tips.values() if v})


def test_forest_and_repeated_edges(spark):
    pairs = [("a", "r1"), ("b", "r1"), ("a", "r1"), ("c", "r2"), (None, "r2"), ("d", None)]
    got = {r.node: (r.parent, r.leave - r.enter) for r in L.interval_labels(frame(spark, pairs)).collect()}
    assert got == {"a": ("r1", 1), "b": ("r1", 1), "c": ("r2", 1), "r1": (None, 5), "r2": (None, 3)}


def test_no_edges(spark):
    labels = L.interval_labels(frame(spark, []))
    assert labels.count() == 0 and L.tips_below(labels).count() == 0 and L.tip_signatures(labels).count() == 0


@pytest.mark.parametrize("pairs", [[("a", "b"), ("a", "c")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "b"), ("x", "y")], [("a", "r"), ("b", "c"), ("c", "b")]])
@pytest.mark.parametrize("block", [2, 1 << 16])
def test_no_tree(spark, monkeypatch, pairs, block):
    monkeypatch.setattr(L, "BLOCK", block)
    with pytest.raises(Exception, match="parent|cycle"):
        L.interval_labels(frame(spark, pairs)).collect()


def test_integer_nodes(spark):
    pairs = spark.range(1, 200).select(F.col("id").alias("child"), F.expr("id DIV 2").alias("parent"))
    got = {r.node: (r.leave - r.enter - 1) // 2 for r in L.interval_labels(pairs).collect()}
    assert got[0] == 199 and got[1] == 198 and got[100] == 0 and got[50] == 2


def test_comb_and_star(spark):
    """A comb of 100,000 nodes deeper than any recursion limit, and a node with as many children."""
    n = 50_000
    spine = spark.range(1, n).select(F.concat(F.lit("node_"), "id").alias("child"), F.concat(F.lit("node_"), F.col("id") - 1).alias("parent"))
    tips = spark.range(n).select(F.concat(F.lit("genus_"), "id").alias("child"), F.concat(F.lit("node_"), "id").alias("parent"))
    comb = spine.unionByName(tips)
    other = comb.select(F.regexp_replace("child", "node_", "node_9").alias("child"), F.regexp_replace("parent", "node_", "node_9").alias("parent"))
    matched = T.match_nodes(comb, other)
    wrong = matched.where("node_b IS NULL OR concat('node_9', substring(node_a, 6)) <> node_b OR n_tips <> 50000 - cast(substring(node_a, 6) AS INT)")
    assert matched.count() == n and wrong.count() == 0
    star = spark.range(2 * n).select(F.concat(F.lit("genus_"), "id").alias("child"), F.lit("ancestral").alias("parent"))
    assert [tuple(r)[:2] for r in L.tip_signatures(L.interval_labels(star)).collect()] == [("ancestral", 2 * n)]


NODES = [(1, 1, "no rank", "root"), (2, 1, "phylum", "P"), (3, 2, "class", "C"), (4, 3, "clade", "K"), (5, 4, "genus", "G"), (6, 5, "species", "S"), (7, 2, "order", "O")]


def test_lineage_walks_up_from_the_ids(spark):
    far = [(100 + i, 100 + i - 1 if i else 1, "clade", f"c{i}") for i in range(150)]
    nodes = spark.createDataFrame(NODES + far + [(300, 249, "species", "deep")], "tax_id long, parent_id long, rank string, name string")
    ids = spark.createDataFrame([(6, "a"), (6, "b"), (7, "c"), (1, "d"), (99, "e"), (300, "f"), (None, "g")], "tax_id long, note string")
    got = {r.note: (r.phylum, r.superorder, r.order, r.genus, r.genus_species) for r in T.lineage(ids, nodes).collect()}
    assert got == {
        "a": ("P", "C", "", "G", "S"), "b": ("P", "C", "", "G", "S"), "c": ("P", "", "O", "", ""),
        "d": ("",) * 5, "e": ("",) * 5, "f": ("", "", "", "", "deep"), "g": ("",) * 5,
    }
    with pytest.raises(Exception, match="(?i)recursion"):
        T.lineage(ids, nodes, deepest=20).collect()


def test_lineage_of_a_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([(1, 2, "x", "x"), (2, 1, "x", "x")], "tax_id long, parent_id long, rank string, name string")
    with pytest.raises(Exception, match="(?i)recursion"):
        T.lineage(spark.createDataFrame([(1,)], "tax_id long"), nodes, deepest=30).collect()
