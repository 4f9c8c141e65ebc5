"""Ranking, statistics, trees, catalogue, checks: worked rows and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from baseloom.functions import cleaning as CL
from baseloom.functions.names import coerce_node, normalize_species
from baseloom.operators import catalog as C
from baseloom.operators import divergence as D
from baseloom.operators import ranking as R
from baseloom.operators import stats as ST
from baseloom.operators import traits as TR
from baseloom.operators import trees as T
from baseloom.operators import validate as V
from baseloom.operators import windows as W
from baseloom.sources.trees_text import parse_gc_trees


def test_exact_quantiles_with_a_hot_group(spark):
    rng = random.Random(1)
    values = [("hot", rng.choice([-2.5, 0.0, 1e-9, rng.gauss(0, 3), 0.41])) for _ in range(4000)]
    values += [("cold", 1.0), ("pair", 1.0), ("pair", 2.0), ("none", None)]
    df = spark.createDataFrame(values, "k string, v double")
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.937, "e": 1.0}
    got = {r["k"]: r for r in R.exact_quantiles(df, ["k"], "v", probs).collect()}
    want = {r["k"]: r["q"] for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", list(probs.values())).alias("q")).collect()}
    assert set(got) == set(want) == {"hot", "cold", "pair"}
    for k, q in want.items():
        assert [got[k][n] for n in probs] == pytest.approx(q)


def test_quantiles_of_one_frequent_value(spark):
    values = [1.0] * 1900 + [float(x) for x in range(2, 102)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double").repartition(4)
    row = R.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()[0]
    want = df.agg(F.percentile("v", [0.5, 0.99])).collect()[0][0]
    assert [row["p50"], row["p99"]] == pytest.approx(want)


def test_assign_pk_and_running_total(spark):
    rows = [(i * 7919 % 1009, i % 5) for i in range(1009)]
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    got = R.assign_pk(df, ["k"], "pk", start=5, buckets=7).collect()
    assert sorted((r["k"], r["pk"]) for r in got) == [(i, i + 5) for i in range(1009)]
    total, want = 0, {}
    for k, v in sorted(rows):
        want[k] = total
        total += v
    assert {r["k"]: r["t"] for r in R.running_total(df, ["k"], "v", "t", buckets=7).collect()} == want


def test_numbers_do_not_depend_on_the_ranges(spark):
    rows = [(None if i % 50 == 0 else i * 7919 % 997, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k bigint, i bigint")
    want = {r: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1)}
    for buckets in (1, 8, 300):
        got = R.assign_pk(df, ["k", "i"], "pk", buckets=buckets).collect()
        assert {(r["k"], r["i"]): r["pk"] for r in got} == want
    assert R.assign_pk(df.where("i < 0"), ["k", "i"], "pk").count() == 0
    plan = R.assign_pk(df, ["k", "i"], "pk")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" not in plan.split("BroadcastExchange")[0]


def test_limit_per_group_and_first(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 3)], "k string, o bigint")
    assert sorted((r["k"], r["o"]) for r in R.limit_per_group(df, ["k"], ["o"], 2).collect()) == [("a", 0), ("a", 1), ("b", 3)]
    rows = spark.createDataFrame([("a", 2, None, "x"), ("a", 1, None, "y"), ("a", 3, 5.0, "z")], "k string, o int, v double, w string")
    assert R.dedupe_first(rows, ["k"], ["o"]).collect()[0]["w"] == "y"
    assert R.collapse_first(rows, ["k"], ["v"], "o").collect()[0]["v"] == 5.0


def test_p_value_and_vif(spark):
    df = spark.createDataFrame([("a", float(x), y) for x, y in enumerate([1.0, 2.1, 2.9, 4.2, 4.8])], "k string, x double, y double")
    row = ST.ols_by(df, ["k"], "x", "y").collect()[0]
    assert row["slope"] == pytest.approx(0.97) and row["n"] == 5
    # Student's t with three degrees of freedom has a closed form.
    x = row["t_abs"] / math.sqrt(3)
    assert row["p_value"] == pytest.approx(1 - 2 / math.pi * (x / (1 + x * x) + math.atan(x)))
    assert ST._beta_fraction(0.5, 2.0, 2.0) == pytest.approx(0.5)
    assert ST._beta_fraction(0.3, 1.0, 0.5) == pytest.approx(1 - math.sqrt(0.7))


@pytest.mark.parametrize(
    "text,mode,want",
    [
        ("Anolis cf. sagrei sagrei", "taxon", "anolis_sagrei"),
        ("Anolis_sagrei", "taxon", "anolis_sagrei"),
        ("Aspidoscelis × uniparens", "taxon", "aspidoscelis_uniparens"),
        ("Anolis 2 sagrei-b", "taxon", "anolis_sagrei-b"),
        ("Anolis [x] sagrei", "trait", "anolis_sagrei"),
        ("N/A", "trait", "unknown_species"),
        ("Anolis sagrei-b (Smith 1900) 2", "full", "anolis_sagrei_b_2"),
        ("Anolis sagrei-b", "full_key", "anolis_sagrei"),
        ("  Anolis   Sagrei sub", "binomial", "Anolis_Sagrei"),
        ("'Anolis [a] sagrei.x'", "label", "anolis_sagrei_x"),
        ("anolis SAGREI sub", "display", "Anolis_sagrei"),
        ("Anolis", "shell", "anolis"),
        (None, "taxon", "unknown_species"),
    ],
)
def test_species_names(spark, text, mode, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(normalize_species(F.col("t"), mode).alias("x")).collect()[0]["x"] == want


def test_node_labels(spark):
    labels = {"Root": "ancestral", "node 7": "node_7", "07": "node_7", "Node_x1": "node_x1", "Anolis sagrei sub": "anolis_sagrei", " ": ""}
    df = spark.createDataFrame([(k,) for k in labels], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", coerce_node(F.col("t")).alias("x")).collect()} == labels


def test_clean_values(spark):
    df = spark.createDataFrame([("2.9",), ("inf",), ("nan",), (" 7 ",), ("x",), (None,)], "t string")
    got = df.select(CL.to_number(F.col("t")).alias("n"), CL.to_integer(F.col("t")).alias("i")).collect()
    assert [r["n"] for r in got] == [2.9, None, None, 7.0, None, None]
    assert [r["i"] for r in got] == [2, None, None, 7, None, None]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "t string").select(CL.canonical_bool(F.col("t"), "strict")).collect()


def test_deep_tree_closure(spark):
    edges = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(21)], "child string, parent string")
    got = {(r["node"], r["ancestor"], r["distance"]) for r in T.ancestor_pairs(edges).collect()}
    assert got == {(f"n{a}", f"n{b}", a - b) for a in range(22) for b in range(a)}


def test_newick_numbering(spark):
    df = spark.createDataFrame([("t", "((A:1,B:2)90:0.1,((C,D),E)x:3)r;", 44)], "tree_id string, newick string, first_id int")
    got = {(r["child"], r["parent"]) for r in T.newick_edges(df).collect()}
    assert got == {
        ("A", "node_44"), ("B", "node_44"), ("C", "node_45"), ("D", "node_45"), ("node_45", "node_46"), ("E", "node_46"),
        ("node_44", "ancestral"), ("node_46", "ancestral"),
    }


def test_newick_nodes_cases(spark):
    rows = [
        ("a", "( (A x:1e-3 , B)0.9 :2, C ) ;", 7), ("b", None, 1), ("c", "", 1), ("d", "lone:3;", 1), ("e", "((A,B)", 1), ("f", "(\u00e9t\u00e9:x,)z;", 3),
    ]
    df = spark.createDataFrame(rows, "tree_id string, newick string, first_id int")
    got = {tuple(r) for r in T.newick_nodes(df).collect()}
    assert got == {
        ("a", "A x", "node_7", True, None, 0.001), ("a", "B", "node_7", True, None, None), ("a", "node_7", "ancestral", False, 0.9, 2.0),
        ("a", "C", "ancestral", True, None, None), ("a", "ancestral", None, False, None, None), ("d", "lone", None, True, None, 3.0),
        ("e", "A", "node_1", True, None, None), ("e", "B", "node_1", True, None, None), ("e", "node_1", None, False, None, None),
        ("f", "\u00e9t\u00e9", "ancestral", True, None, None), ("f", "ancestral", None, False, None, None),
    }
    spark.udtf.register("newick_tokens", T.newick_tokens)
    df.createOrReplaceTempView("some_trees")
    sql = spark.sql("SELECT tree_id, node AS child, parent FROM some_trees, LATERAL newick_tokens(newick, first_id) WHERE parent IS NOT NULL")
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, T.newick_edges(df).collect()))
    with pytest.raises(Exception, match="not open"):
        T.newick_nodes(df.limit(1).withColumn("newick", F.lit("(A));"))).collect()


def test_long_trees_in_one_pass(spark):
    n = 40_000  # 1 MB: a comb of that depth and a star of that width
    comb = "(" * n + "GCA_0.1:0.125" + "".join(f",GCA_{i}.1:0.125)90:0.25" for i in range(1, n + 1)) + ";"
    star = "((" + ",".join(f"T{i} 0.25:0.1" for i in range(n)) + ")41.25:0.3,(x:0.2,y:0.4)39.5:0.7);"
    df = spark.createDataFrame([("comb", comb, 0)], "tree_id string, newick string, first_id int")
    assert len(comb) > 1_000_000
    edges = {r["child"]: r["parent"] for r in T.newick_edges(df).collect()}
    assert len(edges) == 2 * n and edges["GCA_0.1"] == "node_0" and edges["node_0"] == "node_1" and edges[f"node_{n - 2}"] == "ancestral"
    names = spark.createDataFrame([("GCA_7.1", "Genus_a")], "accession string, species string")
    row = T.clean_newick(df, names).collect()[0]
    assert row["n_replaced"] == 1 and row["newick"] == "(" * n + "GCA_0.1" + "".join(f",{'Genus_a' if i == 7 else f'GCA_{i}.1'})" for i in range(1, n + 1)) + ";"
    gc = parse_gc_trees(spark.createDataFrame([("og", star)], "ortholog string, text string"), 5).collect()
    assert len(gc) == n + 2 and [r["node"] for r in sorted(gc, key=lambda r: r["pos"])[-2:]] == ["node_6", "node_7"]


def test_clean_newick_boundaries(spark):
    trees = spark.createDataFrame([("t", "(GCA_1.1:0.01,(GCA_1.10,p|GCA_1.1:1)95.5:1e-3)100;")], "tree_id string, newick string")
    names = spark.createDataFrame([("GCA_1.1", "A_b"), ("GCA_1.10", "C_d")], "accession string, species string")
    row = T.clean_newick(trees, names).collect()[0]
    assert (row["newick"], row["n_replaced"]) == ("(A_b,(C_d,p|GCA_1.1));", 2)


def test_containing_against_every_pair(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\u00e9_") for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["a" * n for n in range(1, 40)]
    parts, wholes = texts[:170] + [None], texts[120:] + [None, texts[-1]]
    got = TR.containing(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in wholes], "whole string"))
    pairs = [tuple(r) for r in got.select("part", "whole").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(p, w) for p in parts for w in wholes if p and w and p in w}
    assert TR.containing(got.select("part").limit(0), got.select("whole")).count() == 0


def test_missing_pairs(spark):
    edges = spark.createDataFrame([("a", "n"), ("n", "r")], "child string, parent string")
    gc = spark.createDataFrame([("g1", "a", 1.0), ("g1", "r", 2.0), ("g2", "zz", 1.0)], "ortholog string, node string, gc double")
    got = {(r["ortholog"], r["child"], r["reason"]) for r in D.missing_pairs(gc, edges).collect()}
    assert got == {
        ("g1", "a", "PARENT_MISSING:n"), ("g1", "n", "CHILD_MISSING"), ("g2", "a", "CHILD_MISSING"), ("g2", "n", "CHILD_MISSING"),
    }
    with pytest.raises(KeyError):
        D.require_complete(gc, edges)
    assert {r["dij"] for r in D.dij(gc, edges).collect()} == {None}


def test_missing_pairs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "NODE_BLOCK", 4)
    tree = [(f"n{i}", f"n{(i - 1) // 2}") for i in range(1, 31)] + [("lost", None)]
    have = {(f"g{g}", f"n{i}") for g in range(7) for i in range(31) if g == 0 or (i * 7 + g * 3) % 11 > g} | {("g9", "beside")}
    edges = spark.createDataFrame(tree, "child string, parent string")
    rows = [(o, n, 1.0) for o, n in sorted(have)] * 2
    gc = spark.createDataFrame(rows, "ortholog string, node string, gc double")
    orthologs, want, counts = sorted({o for o, _ in have}), set(), {}
    for c, p in tree[:-1]:
        absent = [o for o in orthologs if (o, c) not in have]
        half = [o for o in orthologs if (o, c) in have and (o, p) not in have]
        want |= {(o, c, "CHILD_MISSING") for o in absent} | {(o, c, f"PARENT_MISSING:{p}") for o in half}
        counts[c, p] = (len(absent), len(half))
    got = [tuple(r) for r in D.missing_pairs(gc, edges.where("parent IS NOT NULL")).select("ortholog", "child", "reason").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r["child"], r["parent"]): (r["n_child_missing"], r["n_parent_missing"]) for r in D.missing_counts(gc, edges.where("parent IS NOT NULL")).collect()} == counts
    found = {tuple(r) for r in D.missing_nodes(gc, edges).collect()}
    nodes = {n for e in tree for n in e if n}
    assert found == {(o, n) for o in orthologs for n in nodes if (o, n) not in have}


def test_missing_pairs_form_each_missing_node_once(spark, monkeypatch):
    """Null ends and names keep their meaning, repeated rows count once, and no missing row is stored or goes through an exchange."""
    edges = spark.createDataFrame([("a", "n"), ("a", "n"), ("a", "m"), ("n", "r"), (None, "n"), (None, "r"), ("b", None)], "child string, parent string")
    gc = spark.createDataFrame([("g1", "a"), ("g1", "a"), ("g1", "r"), ("g2", "n"), (None, "a"), ("g3", None)], "ortholog string, node string")
    monkeypatch.setattr(D, "stored", lambda df: pytest.fail("missing rows are stored"))
    pairs = D.missing_pairs(gc, edges)
    tree, have = {tuple(r) for r in edges.collect()}, {tuple(r) for r in gc.collect()}
    want = []
    for o in {o for o, _ in have}:
        lost = {n for e in tree for n in e if n and (o is None or (o, n) not in have)}
        want += [(o, c, "CHILD_MISSING") for c in {c for c, _ in tree} & lost]
        want += [(o, c, f"PARENT_MISSING:{p}") for c, p in tree if p in lost and (c not in lost or o is None)]
    null_last = lambda r: [x or "~" for x in r]
    # An unnamed ortholog has both reasons for an edge, as before.
    assert sorted(map(tuple, pairs.collect()), key=null_last) == sorted(want, key=null_last)


@pytest.mark.parametrize("sent", [1 << 19, 0])
def test_missing_pairs_move_what_is_there_and_come_by_block(spark, monkeypatch, sent):
    """No exchange holds a row per ortholog and node block, and a task puts out block after block, whatever the orthologs."""
    for name, value in (("NODE_BLOCK", 4), ("BLOCKS_TOGETHER", 2), ("ORTHOLOGS_TOGETHER", 5), ("NAMES_SENT", sent)):
        monkeypatch.setattr(D, name, value, raising=False)
    tree = [(f"n{i:02}", f"n{(i - 1) // 2:02}") for i in range(1, 41)] + [("n05", "n01"), ("x", "beside")]
    have = {(f"g{g}", f"n{i:02}") for g in range(12) for i in range(41) if (i * 7 + g * 3) % 11 > g} | {("g77", "elsewhere"), ("g78", "x")}
    want = [(o, c, "CHILD_MISSING") for o in {o for o, _ in have} for c in {c for c, _ in tree} if (o, c) not in have]
    want += [(o, c, f"PARENT_MISSING:{p}") for o, n in have for c, p in tree if n == c and (o, p) not in have]
    gc = spark.createDataFrame(sorted(have) * 3, "ortholog string, node string")
    edges = spark.createDataFrame(tree, "child string, parent string")
    pairs = D.missing_pairs(gc, edges)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(want)
    assert sorted(tuple(r) for r in D.missing_nodes(gc, edges).collect()) == sorted((o, n) for o in {o for o, _ in have} for n in {n for e in tree for n in e} if (o, n) not in have)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(node" not in plan and "every" not in plan and "_has" not in plan
    if sent:
        place = {c: k // 4 for k, c in enumerate(sorted({c for c, _ in tree}))}
        rows = pairs.where("reason = 'CHILD_MISSING'").select(F.spark_partition_id().alias("task"), "child", "ortholog").collect()
        runs = [(r.task, place[r.child]) for r in rows]
        starts = [x for k, x in enumerate(runs) if k == 0 or runs[k - 1] != x]
        assert len(starts) == len(set(starts)) < len(rows) / 3


def brute_updates(existing, new):
    rows = {a: dict(sp=s, cur=c, by=b) for a, s, c, b in existing}
    events = []
    for a, s in new:
        hit = [row for other, row in rows.items() if row["sp"] == s and other != a]
        for row in hit:
            row["cur"], row["by"] = False, a
        events.append((a, len(hit)))
        rows[a] = dict(sp=s, cur=True, by="")
    return rows, events


def test_supersession_in_order(spark):
    rng = random.Random(3)
    existing = [(f"A{i}", f"s{i % 4}", True, "") for i in range(8)]
    new = [(f"A{rng.randrange(14)}", None) for _ in range(12)]
    new = [(a, f"s{int(a[1:]) % 4}") for a, _ in new]
    old = spark.createDataFrame(existing, "accession string, species_key string, is_current_for_species boolean, replaced_by_accession string")
    fresh = spark.createDataFrame([(a, s, True, "", i) for i, (a, s) in enumerate(new)], old.schema.simpleString()[7:-1].replace(":", " ") + ", seq bigint")
    rows, events = brute_updates(existing, new)
    got = {r["accession"]: (r["is_current_for_species"], r["replaced_by_accession"]) for r in C.apply_updates(old, fresh).collect()}
    assert got == {a: (r["cur"], r["by"]) for a, r in rows.items()}
    logged = {r["seq"]: (r["new_accession"], r["n_superseded"]) for r in C.supersession_events(old, fresh).collect()}
    counted = {i: (a, n) for i, (a, n) in enumerate(events) if n}
    assert logged == counted


def test_new_entries_compare_whole_keys(spark):
    updates = spark.createDataFrame([("X.1",), ("X.10",)], "accession string")
    catalog = spark.createDataFrame([("X.10",)], "accession string")
    assert [r["accession"] for r in C.new_entries(updates, catalog).collect()] == ["X.1"]


def test_strict_selection_and_lookup(spark):
    manifest = spark.createDataFrame([("a", 0), ("b", 1)], "accession string, row_idx bigint")
    with pytest.raises(ValueError, match="zz"):
        C.select_accessions(manifest, "explicit", ids=["a", "zz"])
    with pytest.raises(ValueError, match="only 1 of 2"):
        C.select_accessions(manifest, "extra", default=["a"], n=2)
    meta = spark.createDataFrame([("a", "/p", "Genus one"), ("b", "/q", "Genus one")], "accession string, path_to_fna string, organism_name string")
    with pytest.raises(LookupError):
        C.lookup_genome(meta, "genus_one")
    with pytest.raises(ValueError, match="b"):
        C.attach_fasta(meta.select("accession"), spark.createDataFrame([("a", "/p")], "accession string, path_to_fna string"))


def test_join_cardinality(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    right = spark.createDataFrame([(1, "x")], "k int, v string")
    assert V.join_validated(left, right, ["k"], "left", "m:1").count() == 2
    with pytest.raises(ValueError, match="left side"):
        V.join_validated(left, right, ["k"], "left", "1:1")


def test_headers_and_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Gene Start` int, b int")
    assert V.pick_column(df, ["gene_start"]) == "Gene Start"
    assert V.pick_column(df, ["zz"], required=False) is None
    assert V.validate_headers({"t": df}, {"t": ["Gene Start", "b"]}) == []
    assert "missing ['c']" in V.validate_headers({"t": df}, {"t": ["c"]})[0]
    with pytest.raises(ValueError, match="x, y"):
        V.require(["a"], ["a", "x", "y"])


def test_labels_by_substring(spark):
    left = spark.createDataFrame([("lis sag",), ("none",), ("Anolis sagrei",)], "label string")
    right = spark.createDataFrame([("Anolis_sagrei_x", 0), ("Anolis.sagrei", 1)], "label string, row_idx bigint")
    got = {r["label"]: (r["resolved"], r["match_method"], r["n_candidates"]) for r in TR.resolve_labels(left, right, True).collect()}
    assert got["Anolis sagrei"] == ("Anolis.sagrei", "exact_normalized", 1)
    assert got["lis sag"] == ("Anolis_sagrei_x", "substring_normalized_ambiguous", 2)
    assert got["none"] == (None, "unmatched", 0)


def test_scope_labels():
    assert W.scope_label(["Scaffold", "chromosome"]) == "chromosome_plus_scaffold"
    assert W.scope_label(["x", "chromosome"]) == "chromosome_plus_x"


def test_merge_diagnostics_form_the_values_once(spark, data, monkeypatch):
    from workload import divergence_queries as Q

    calls, whole = [], Q.I.node_gc
    monkeypatch.setattr(Q.I, "node_gc", lambda spark, d: calls.append(d) or whole(spark, d))
    assert Q.diagnostics(spark, data).count() == 8 and len(calls) == 1
