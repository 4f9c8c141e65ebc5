"""The chunk store: what a join with it moves, and slices that cross chunks or leave the sequence."""

import random
import re

import pytest
from pyspark.sql import functions as F

from baseloom.operators import intervals as IV
from baseloom.operators.windows import chunk_sequences
from baseloom.sources import chunk_store as CS

BP = 7
random.seed(4)
TEXT = {f"s{i}": "".join(random.choice("ACGTN") for _ in range(n)) for i, n in enumerate((1, 6, 7, 8, 50, 333, 0))}


@pytest.fixture(scope="module")
def store(spark):
    seqs = spark.createDataFrame([(1, k, t) for k, t in TEXT.items()], "genome_pk long, sequence_id string, bases string")
    return CS.write_chunk_store(chunk_sequences(seqs, BP), buckets=4)


def models(spark, n=200):
    rows = []
    for g in range(n):
        name = random.choice([*TEXT, "unknown"])
        starts = sorted(random.sample(range(1, 400), random.randint(1, 4)))
        exons = [(a, min(a + random.randint(0, 30), b - 1)) for a, b in zip(starts, [*starts[1:], 10**12])]
        if g % 50 == 0:
            exons[-1] = (exons[-1][0], 10**12)  # far beyond the end
        rows.append((1, f"g{g}", name, "Single", random.choice("+-"), exons[0][0], exons[-1][1], exons))
    return spark.createDataFrame(
        rows,
        "genome_pk long, gene string, sequence_id string, status string, strand string, start long, end long, exons array<struct<start:long,end:long>>",
    )


def moved(df):
    """Inputs of the exchanges of a plan, and how often bases are scanned."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = re.split(r"\n\n+", plan)
    exchanges = [p for p in parts if re.match(r"\(\d+\) (Broadcast)?Exchange", p)]
    return exchanges, sum(bool(re.match(r"\(\d+\) Scan", p)) and "bases#" in p for p in parts)


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lengths(store):
    got = {r.sequence_id: (r.sequence_length, r.n_chunks) for r in store.sequences.collect()}
    assert got == {k: (len(t), -(-len(t) // BP)) for k, t in TEXT.items() if t}


def test_bases_are_not_moved(spark, store, no_broadcast):
    genes = models(spark)
    introns = IV.infer_introns(genes)
    for out, scans in (
        (IV.extract_cds(genes, store, BP), 1),
        (IV.extract_introns(introns, store, BP), 1),
        (IV.extract_flanks(genes, store, BP), 1),
        (IV.slice_intervals(store, genes, BP, ["genome_pk", "gene"]), 1),
    ):
        exchanges, found = moved(out)
        assert exchanges and not any(re.search(r"\bbases#", e) for e in exchanges)
        assert found == scans


def test_slices_equal_those_of_plain_chunks(spark, store):
    genes = models(spark)
    chunks = store.bases.select("genome_pk", "sequence_id", "chunk_no", "bases")
    plain = genes.where("end < 1000000")  # without a store an interval is laid out as given
    key = lambda r: str(r)
    for make in (
        lambda c, g: IV.extract_cds(g, c, BP),
        lambda c, g: IV.extract_introns(IV.infer_introns(g), c, BP),
        lambda c, g: IV.extract_flanks(g, c, BP),
    ):
        a, b = (sorted(make(c, plain).collect(), key=key) for c in (store, chunks))
        assert a == b and len(a) > 100


def test_slices_are_cut_where_they_lie(spark, store, no_broadcast, monkeypatch):
    """No text goes through an exchange; intervals of all lengths, that repeat, have no bounds, or lie on odd chunks."""
    monkeypatch.setattr(IV, "HALF_BP", 14, raising=False)
    turn, rng = str.maketrans("ACGTN", "TGCAN"), random.Random(8)
    asked = [(1, f"k{i}", rng.choice([*TEXT, "unknown"]), rng.choice("+-"), a, a + rng.choice([0, 3, 6, 7, 13, 14, 15, 40, 100, 400, 10**12])) for i in range(300) for a in [rng.randint(-5, 360)]]
    asked += [(1, "k0", "s5", "+", a, b) for a, b in ((1, 5), (2, 333), (2, 333), (9, 3), (None, 4), (4, None), (334, 340), (8, 7 * 28), (330, 10**12))]
    asked += [(None, "k0", "s5", "+", 1, 2), (1, None, "s5", "-", 3, 30)]
    rows = spark.createDataFrame(asked, "genome_pk long, name string, sequence_id string, strand string, start long, end long")
    chunks = store.bases.select("genome_pk", "sequence_id", "chunk_no", "bases")
    want = []
    for g, k, s, strand, a, b in asked:
        if g and TEXT.get(s):
            text = "" if a is None or b is None or b < 1 else TEXT[s][max(a, 1) - 1 : b]
            want.append((g, k, s, strand, a, b, text[::-1].translate(turn) if strand == "-" else text))
    for source in (store, chunks):
        out = IV.slice_intervals(source, rows, BP, ["genome_pk", "name"])
        assert out.columns == ["genome_pk", "name", "sequence_id", "strand", "start", "end", "seq"]
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
        exchanges, _ = moved(out)
        assert exchanges and not any(re.search(r"\b(piece|seq)#", e) for e in exchanges)
    # Chunks that are there twice, or not at all.
    odd = chunks.where("sequence_id = 's5' AND chunk_no NOT IN (3, 4)").unionByName(chunks.where("sequence_id = 's5' AND chunk_no = 2"))
    got = {r.name: r.seq for r in IV.slice_intervals(odd, rows.where("sequence_id = 's5' AND strand = '+' AND genome_pk = 1 AND name <> 'k0'"), BP, ["name"]).collect()}
    assert len(got) > 10
    for _, k, _, _, a, b in (r for r in asked if r[1] in got):
        text = "".join(TEXT["s5"][max(a - 1, c * BP) : min(b, (c + 1) * BP)] * (2 if c == 2 else 1) for c in range(48) if c not in (3, 4) and max(a - 1, c * BP) < b)
        assert got[k] == text


def test_cds_by_hand(spark, store):
    turn = str.maketrans("ACGTN", "TGCAN")
    for r in models(spark).alias("m").collect():
        if r.gene in ("g0", "g50", "g7", "g8", "g9"):
            one = spark.createDataFrame([r], models(spark, 1).schema)
            got = IV.extract_cds(one, store, BP).collect()
            if not TEXT.get(r.sequence_id):
                assert got == []
                continue
            text = "".join(TEXT[r.sequence_id][s - 1 : e] for s, e in r.exons)
            assert got[0].seq == (text[::-1].translate(turn) if r.strand == "-" else text)


def test_far_exons_reach_the_end(spark, data):
    from workload import inputs as I

    ends = I.far_models(spark, data).select("sequence_id", F.explode("exons").alias("e")).select("sequence_id", "e.start")
    seqs = I.seqs(spark, data).select("sequence_id", "sequence_length")
    got = ends.join(seqs, "sequence_id").where("sequence_length > 2000").agg(F.max(F.col("start") / F.col("sequence_length")), F.min("start")).first()
    assert got[0] > 0.8


def test_names(spark, store):
    again = CS.open_chunk_store(spark, store.name)
    assert again.bases.count() == store.bases.count()
    other = CS.write_chunk_store(store.bases.where("sequence_id = 's4'"), buckets=2)
    assert CS.is_whole(spark, other)
    CS.drop_chunk_store(spark, other.name)
    assert not CS.is_whole(spark, other)
    assert not spark.catalog.tableExists(f"{other.name}_bases")
