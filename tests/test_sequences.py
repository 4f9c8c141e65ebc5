"""Sequences: codons, windows, intervals; each trap with rows worked by hand."""

import random

import pytest
from pyspark.sql import functions as F

from baseloom.functions import sequence as S
from baseloom.operators import alignments as A
from baseloom.operators import features as FT
from baseloom.operators import intervals as IV
from baseloom.operators import windows as W


def one(df):
    return df.collect()[0].asDict()


def test_composition_traps(spark):
    rows = [
        ("plain", "ATGGCTTAA"),
        ("inner_stop", "TAAGCCGTC"),
        ("short", "AT"),
        ("empty", ""),
        ("gapped", "GC-CGT-A"),
        ("no_base", "NNN"),
        ("stop_out_of_frame", "GCCATAA"),
    ]
    got = {r["k"]: r for r in FT.cds_composition(spark.createDataFrame(rows, "k string, seq string")).collect()}
    assert got["plain"]["gc3"] == 0.5 and got["plain"]["gc4"] == 0.0  # GCT is the only family codon
    assert got["inner_stop"]["gc3"] is None and got["inner_stop"]["gc4"] == 1.0
    assert got["short"]["gc3"] is None and got["short"]["gc4"] is None and got["short"]["gc"] == 0.0
    assert got["empty"]["gc"] is None and got["empty"]["gc3"] is None
    assert got["gapped"]["gc"] == pytest.approx(4 / 6)
    assert got["no_base"]["gc"] is None
    assert got["stop_out_of_frame"]["gc4"] is None


def test_quality_counts_stops_out_of_frame(spark):
    row = one(FT.cds_quality(spark.createDataFrame([("x", "TAAGCCTGAC")], "k string, seq string")))
    assert row["internal_stop_count"] == 1 and row["terminal_stop"] is True
    assert row["protein_length"] == 2 and row["failure_reasons"] == "length_not_divisible_by_3;internal_stop_codons"
    row = one(FT.cds_quality(spark.createDataFrame([("x", "RYN?-AA")], "k string, seq string")))
    assert (row["ambiguous_count"], row["invalid_count"], row["failure_reasons"]) == (3, 1, "invalid_characters")


def test_translate_and_revcomp(spark):
    df = spark.createDataFrame([("ATGTGANNNTT", "AcgRn")], "a string, b string")
    row = one(df.select(S.translate_dna(F.col("a")).alias("p"), S.reverse_complement(F.col("b")).alias("r")))
    assert row["p"] == "M*X" and row["r"] == "nYcgT"


def brute_windows(text, size, step, offset=0):
    out = []
    for rank, start in enumerate(range(offset, len(text), step), 1):
        part = text[start : start + size].upper()
        acgt = sum(part.count(b) for b in "ACGT")
        out.append((rank, start + 1, start + len(part), part.count("G") + part.count("C"), acgt, part.count("-")))
    return out


@pytest.mark.parametrize("size,step,offset", [(6, 6, 0), (7, 7, 0), (10, 4, 0), (5, 9, 0), (6, 6, 3), (50, 3, 2)])
def test_windows_against_brute_force(spark, size, step, offset):
    rng = random.Random(size * 100 + step)
    texts = {i: "".join(rng.choice("ACGTNacgt-") for _ in range(n)) for i, n in enumerate([0, 1, 11, 12, 13, 60, 97], 1)}
    seqs = spark.createDataFrame([(1, k, t) for k, t in texts.items()], "genome_pk bigint, sequence_pk bigint, bases string")
    got = W.tile_windows(W.chunk_sequences(seqs, 12), [size], [step], start_offset=offset, chunk_bp=12)
    rows = {}
    for r in got.collect():
        rows.setdefault(r["sequence_pk"], []).append((r["window_rank"], r["start_bp"], r["end_bp"], r["gc_bp"], r["callable_bp"], r["gap_bp"]))
    for k, text in texts.items():
        assert sorted(rows.get(k, [])) == brute_windows(text, size, step, offset)


def test_window_steps_must_pair():
    with pytest.raises(ValueError):
        W.pair_steps([100, 50], [10])
    assert W.pair_steps([100, 50], [10, 10]) == [(100, 10), (50, 10)]


def test_spread_of_one_window(spark):
    seqs = spark.createDataFrame([(1, 1, "ACGTACGTAC")], "genome_pk bigint, sequence_pk bigint, bases string")
    row = one(W.sequence_summary(W.tile_windows(W.chunk_sequences(seqs, 10), [10], chunk_bp=10)))
    assert row["sd_gc"] == 0.0 and row["var_gc"] == 0.0 and row["mad_gc"] == 0.0
    none = one(W.sequence_summary(W.tile_windows(W.chunk_sequences(seqs, 10), [20], chunk_bp=20)))
    assert none["n_windows_kept"] == 0 and none["mean_gc"] is None and none["callable_bp_total"] == 0


def models(spark, rows):
    schema = "genome_pk bigint, gene string, sequence_id string, status string, strand string, start bigint, end bigint, exons array<struct<start: bigint, end: bigint>>"
    return spark.createDataFrame(rows, schema)


def chunks(spark, text, size=7):
    seqs = spark.createDataFrame([(1, "c", text)], "genome_pk bigint, sequence_id string, bases string")
    return W.chunk_sequences(seqs, size)


def test_slices_clip_and_empty(spark):
    text = "ACGTTGCANNACGGT"
    spans = [("a", 1, 4), ("b", -3, 2), ("c", 14, 99), ("d", 5, 4), ("e", 40, 50), ("f", 2, 15)]
    df = spark.createDataFrame([(1, "c", k, "+", a, b) for k, a, b in spans], "genome_pk bigint, sequence_id string, k string, strand string, start bigint, end bigint")
    got = {r["k"]: r["seq"] for r in IV.slice_intervals(chunks(spark, text), df, 7, ["k"]).collect()}
    for k, a, b in spans:
        assert got[k] == text[max(a, 1) - 1 : max(b, 0)] if b >= a else got[k] == ""


def test_introns_and_flanks(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("ACGTN") for _ in range(120))
    exons = [(10, 20), (15, 30), (31, 40), (60, 70), (65, 66)]
    rows = [(1, s, "c", "Single", s, 10, 70, exons) for s in "+-"]
    introns = IV.infer_introns(models(spark, rows)).orderBy("gene", "intron_no").collect()
    assert [(r["gene"], r["start"], r["end"]) for r in introns] == [("+", 41, 59), ("-", 41, 59)]
    flanks = {(r["gene"], r["flank_set_pk"]): r for r in IV.extract_flanks(models(spark, rows), chunks(spark, text), 7).collect()}
    plus, minus = flanks["+", 2], flanks["-", 1]
    assert (plus["up_start"], plus["up_end"], plus["down_start"], plus["down_end"]) == (1, 9, 71, 170)
    assert (minus["up_start"], minus["up_end"], minus["down_start"], minus["down_end"]) == (71, 120, 1, 9)
    both = text[0:9] + text[70:120]
    assert plus["length"] == sum(both.count(b) for b in "ACGT")
    assert plus["gc"] == pytest.approx((both.count("G") + both.count("C")) / plus["length"])


def test_cds_skips_bad_genes(spark):
    rows = [(1, "ok", "c", "Single", "-", 1, 9, [(1, 3), (7, 9)]), (1, "lost", "x", "Single", "+", 1, 3, [(1, 3)]), (1, "dup", "c", "Duplicated", "+", 1, 3, [(1, 3)])]
    got = IV.extract_cds(models(spark, rows), chunks(spark, "AAACCCGGGTTT"), 7).collect()
    assert [(r["gene"], r["seq"]) for r in got] == [("ok", "CCCTTT")]


def brute_gc4(records, same):
    width = len(next(iter(records.values())))
    families = ("GT", "CC", "AC", "GC", "GG", "CT", "CG", "TC")
    kept = []
    for i in range(0, width, 3):
        column = [s[i : i + 3] for s in records.values()]
        if any(c in "-!N" for codon in column for c in codon) or any(c[:2] not in families for c in column):
            continue
        if same and len({c[:2] for c in column}) > 1:
            continue
        kept.append(i + 2)
    return {k: "".join(s[i] for i in kept) for k, s in records.items()}


@pytest.mark.parametrize("same", [False, True])
def test_gc4_masks_against_brute_force(spark, same):
    rng = random.Random(9)
    alignments = {}
    for a in range(6):
        base = [rng.choice("ACGT") for _ in range(3 * rng.choice([1, 63, 64, 65, 130]))]
        alignments[f"a{a}"] = {
            f"s{k}": "".join(rng.choice("ACGTNR-!") if rng.random() < 0.08 else b for b in base) for k in range(rng.choice([1, 2, 3]))
        }
    rows = [(a, s, t.lower() if s == "s0" else t) for a, r in alignments.items() for s, t in r.items()]
    got = A.gc4_alignment(spark.createDataFrame(rows, "alignment string, sequence_id string, seq string"), same_family=same)
    for r in got.collect():
        want = brute_gc4(alignments[r["alignment"]], same)[r["sequence_id"]]
        counts = {b: want.count(b) for b in "GCAT"}
        assert r["retained_gc4_sites"] == len(want)
        assert [r[f"{b.lower()}_gc4"] for b in "GCAT"] == [counts[b] for b in "GCAT"]
        valid = sum(counts.values())
        assert r["gc4"] == pytest.approx((counts["G"] + counts["C"]) / valid if valid else 0.0)


def test_bad_alignment_stops(spark):
    df = spark.createDataFrame([("a", "x", "ACG"), ("a", "y", "AC"), ("b", "x", "ACG")], "alignment string, sequence_id string, seq string")
    with pytest.raises(ValueError, match="a: unequal_lengths;length_not_divisible_by_3"):
        A.require_valid_alignments(df)


def test_kernels_work_in_slabs(monkeypatch):
    """Working memory is a multiple of a slab, not of the batch; the slab's size does not change the counts."""
    import tracemalloc

    import pyarrow as pa

    from baseloom.functions import kernels as K
    from workload import inputs as I

    plain = lambda f: getattr(f, "func", f)
    few = pa.array(["ACGTAA", None, "", "ac-gtNtaa" * 30, "ATGGCCTAA"])
    kernels = [plain(K.cds_counts), plain(K.codon_words("-!N")), plain(I.dna_of)]
    whole = [k(few).to_pylist() for k in kernels]
    assert whole[2][:3] == ["ACGTAA", None, ""]
    many = pa.array(["ACGTTGCAGGTACC" * 500] * 1200)
    for kernel in kernels:
        tracemalloc.start()
        kernel(many)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 160 * K.SLAB_BASES, kernel
    monkeypatch.setattr(K, "SLAB_BASES", 7)
    assert [k(few).to_pylist() for k in kernels] == whole
