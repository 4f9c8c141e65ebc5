"""What the joins of near copies move and hold, on small tables of their own."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from baseloom.llm import jaccard_join as J
from baseloom.llm import line_dedup as L
from baseloom.llm import packing, tokens


def test_lines_are_placed_once(spark):
    text = "one line of some length here\n\n  two \t\nanother line of this small text\r"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, " \n"), (None, "two")], "doc_id long, text string").coalesce(1)
    lines = L.lines_of(docs)
    rows = L.placed(lines).collect()
    assert len(rows) == 10 and sum(r.head for r in rows) == 4
    assert sum(r["keys"] is not None and len(r["keys"]) == L.BANDS for r in rows) == 3
    assert {(r.place, r.size) for r in rows if r.doc_id == 2} == {(0, 28), (2, 3), (3, 31)}
    found = L.removed_lines(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "distinct" not in plan and "posexplode" not in plan
    got = {(r.doc_id, r.n_lines, r.n_chars, tuple(r.removed)) for r in found.collect()}
    assert got == {(None, 1, 3, ()), (1, 3, 59, (2,)), (2, 3, 0, (0, 2, 3))}


def test_line_pairs_meet_in_blocks():
    lines = [f"{'the quick brown fox jumps over the lazy dog ' * 3}{i % 4}" for i in range(80)] + [str((i + 2) ** 40) for i in range(20)]
    s = L.signatures(lines, L.SKETCH)
    bands = L._bands(s)
    rows = sorted((int(bands[i, b]), 0, 0, 0, i) for i in range(100) for b in range(L.BANDS))
    order = [r[4] for r in rows]
    whole = pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], pa.int64()) for c in range(5)]
        + [pa.array(order, pa.int64()), pa.array([s[i].tobytes() for i in order], pa.binary()), pa.array([bands[i].tobytes() for i in order], pa.binary()), pa.array([lines[i] for i in order])],
        names=["key", "l", "r", "side", "f", "component", "sketch", "bands", "line"],
    )
    out = [p for b in L._paired(whole.slice(at, 37) for at in range(0, len(rows), 37)) for p in zip(*(c.to_pylist() for c in b.columns))]
    # A block puts out a forest: no pair more than it takes to join the 80.
    assert len(out) == 79 and {x for p in out for x in p} == set(range(80))


def test_group_counts_fit_in_bytes():
    few, many = np.arange(1000, dtype="i8"), np.zeros(700, "i8")
    assert len(J.packed_counts(few)) == J.DIMENSIONS
    got = J.counts_of(pa.array([J.packed_counts(x) for x in (few, many, few)], pa.binary()))
    assert got.sum(axis=1).tolist() == [1000, 700, 1000] and got[1, 0] == 700 and (got[0] == got[2]).all()


def test_verification_moves_pairs_only(spark):
    sets = spark.createDataFrame([(i, list(range(i, i + 20))) for i in range(40)], "f long, h array<long>")
    name = J._bucketed(sets, "f")
    pairs = spark.createDataFrame([(i, i + d) for i in range(30) for d in (1, 5)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = J._verified(pairs, spark.table(name))
        plan = links._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 2 and plan.count("Exchange") == 2
        assert {tuple(r) for r in links.collect()} == {(i, i + 1) for i in range(30)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")


def test_packing_forgets_pieces(spark):
    coder = tokens.encoder()
    texts = ["some words and some more words", None, "other words"]
    ids = coder.encode(texts)
    assert len(coder.later) > 0
    coder.forget()
    assert len(coder.later) == 0 and len(coder.first) == 0 and coder.encode(texts) == ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(packing.pack(docs, keep=False).collect()) == sorted(packing.pack(docs).collect())


def test_only_needed_texts_move(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(None, None)], "doc_id long, text string")
    h = F.xxhash64("text")
    wanted = docs.where("doc_id % 100 = 0 or text is null").select(h.alias("h"))
    got = [r.doc_id for r in J.sifted(docs, h, wanted).collect()]
    assert set(range(0, 3000, 100)) | {None} <= set(got) and len(got) < 200
    # A bitmap that is full lets all through, and never loses one.
    some = J.sifted(docs, h, docs.select(h.alias("h")), most_bits=15)
    assert some.count() == 3001 and J.sifted(docs, h, wanted.limit(0)).count() == 0


def test_sketches_lose_no_link(spark):
    rng = np.random.RandomState(2)
    same = [(k << 16) + 7 for k in range(40)]
    sets = [(0, same), (1, same), (2, same[:30] + list(range(10))), (3, list(range(100, 140)))]
    sets += [(10 + i, sorted(rng.choice(60, 40, replace=False).tolist())) for i in range(20)]
    table = spark.createDataFrame(sets, "f long, h array<long>").select("f", F.size("h").alias("n"), J.sketch(F.col("h")).alias("s"), "h")
    pairs = spark.createDataFrame([(a, b) for a, _ in sets for b, _ in sets if a < b], "a long, b long")
    alike = {tuple(r) for r in J._alike(pairs, table).collect()}
    links = {tuple(r) for r in J._verified(pairs, table).collect()}
    want = {(a, b) for a, p in sets for b, q in sets if a < b and 100 * len({*p} & {*q}) >= 75 * len({*p} | {*q})}
    assert links == want and want <= alike and (0, 1) in want and (0, 3) not in alike and len(alike) < pairs.count()


def test_small_groups_put_out_pairs(monkeypatch):
    """Pairs of small groups need no vectors; rows of large groups go on, wherever batches are cut."""
    monkeypatch.setattr(J, "LONG_RUN", 50)
    key = np.r_[[1, 1, 1], np.full(40, 2), [3, 3], np.full(120, 4), np.full(35, 6), [8, 8]].astype("i8")
    f = np.r_[[7, 8, 9], np.arange(40), [8, 7], np.arange(120), np.arange(35), [1, 2]].astype("i8")
    n, part = np.full(len(key), 10, "i8"), f.copy()
    part[2] = 7
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in (key, f, n, n, part)], names=["key", "f", "n", "room", "component"])
    for step in (*range(1, 60), 1000):
        rows = [r for b in J._met(whole.slice(at, step) for at in range(0, len(key), step)) for r in b.to_pylist()]
        assert {(r["f"], r["other"]) for r in rows if r["other"] is not None} == {(7, 8), (8, 9), (1, 2)}
        assert [(r["key"], r["f"]) for r in rows if r["other"] is None] == [(2, i) for i in range(40)] + [(4, i) for i in range(120)] + [(6, i) for i in range(35)]


def test_hubs_go_on_over_batches():
    key = np.r_[np.full(5, 1), [2], np.full(4, 3)].astype("i8")
    f, n = np.arange(10, 20).astype("i8"), np.r_[10, 10, 99, 9, 8, 5, 10, 13, 14, 7].astype("i8")
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(f), pa.array(n)], names=["key", "f", "n"])
    for step in (1, 3, 100):
        rows = [(r["hub"], r["f"]) for b in J._hubbed(whole.slice(at, step) for at in range(0, 10, step)) for r in b.to_pylist()]
        assert rows == [(10, 11), (10, 13), (10, 14), (16, 17)]


def test_candidates_move_without_whole_sets(spark):
    """Many documents that share rare keys but link with none: their sets stay where they are, their texts move once."""
    common = [" ".join(f"c{g}w{k}" for k in range(16)) for g in range(40)]
    rows = [(i, " ".join([common[i % 40]] + [f"d{i}w{k}" for k in range(30)])) for i in range(160)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(20)] + [(None, rows[0][1]), (0, rows[0][1])]
    seen = []
    staged, J.staged = J.staged, lambda df, label: seen.append((label, staged(df, label))) or seen[-1][1]
    try:
        got = {(r.doc_id, r.component_id) for r in J.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        J.staged = staged
    assert got == {(i, i if i < 1000 else i - 1000) for i, _ in rows if i is not None} | {(None, 0)}
    size = {label: df.count() for label, df in seen}
    assert size["searched"] > 4 * size["alike"] and size["met"] > 0
