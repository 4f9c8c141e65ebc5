"""Introns cut in blocks and checked, gene tables read without gathering a file, orthologs from models formed once."""

import random
import re

from pyspark.sql import functions as F

from baseloom.operators import intervals as IV
from baseloom.operators.windows import chunk_sequences
from baseloom.sources import chunk_store as CS
from baseloom.sources import tables as TB
from workload import feature_queries as Q

BP = 7
TURN = str.maketrans("ACGTN", "TGCAN")


def sequences(spark):
    r = random.Random(5)
    text = {f"s{i}": "".join(r.choice("ACGTN") for _ in range(n)) for i, n in enumerate((1, 6, 7, 8, 50, 333))}
    df = spark.createDataFrame([(1, k, t) for k, t in text.items()], "genome_pk long, sequence_id string, bases string")
    return text, chunk_sequences(df, BP)


def reported(spark, text):
    """Introns by hand: right and wrong ones, beyond the ends, on unknown sequences, and each tenth one twice."""
    r, rows = random.Random(6), []
    for i in range(300):
        name, strand = r.choice([*text, "unknown"]), r.choice("+-")
        start = r.choice([r.randint(1, 60), r.randint(1, 400)])
        end = r.choice([start + r.randint(0, 9), start + r.randint(0, 200), 10**6])
        want = text.get(name, "")[start - 1 : end]
        want = want[::-1].translate(TURN) if strand == "-" else want
        given = r.choice([want, want.lower(), want[:-1], "N" + want[1:], None])
        row = (1, f"i{i}", name, strand, start, end, end - start + r.choice([0, 1]), given)
        rows += [row] * (2 if i % 10 == 0 else 1)
    return spark.createDataFrame(rows, "genome_pk long, intron_id string, sequence_id string, strand string, start long, end long, length long, seq string")


def checked(text, row):
    t = text[row.sequence_id]
    want = t[row.start - 1 : row.end]
    want = want[::-1].translate(TURN) if row.strand == "-" else want
    seq = None if row.seq is None else row.seq.upper()
    left = t[max(1, row.start - 5) - 1 : row.start + 4]
    right = t[max(1, row.end - 4) - 1 : row.end + 5]
    return (row.intron_id, None if seq is None else seq == want, want[:20], want[-20:], left, right)


def test_each_reported_row_is_checked_for_itself(spark, monkeypatch):
    text, chunks = sequences(spark)
    rows = reported(spark, text)
    wanted = sorted((checked(text, x) for x in rows.collect() if x.sequence_id in text), key=str)
    store = CS.write_chunk_store(chunks, buckets=3)
    names = ["intron_id", "sequence_match", "expected_first_20", "expected_last_20", "left_boundary_sequence", "right_boundary_sequence"]
    for block in (1, 21, 32_768):
        monkeypatch.setattr(IV, "BLOCK_BP", block)
        for bases in (store, chunks):
            got = IV.validate_introns(rows, bases, BP, boundary=5).select(*names).collect()
            assert sorted((tuple(x) for x in got), key=str) == wanted


def test_missing_bounds(spark):
    text, chunks = sequences(spark)
    rows = spark.createDataFrame([(1, "s5", None, 9), (1, "s5", 3, None), (1, "s5", 9, 3), (1, "s5", 3, 9)], "genome_pk long, sequence_id string, start long, end long")
    got = IV.cut_spans(chunks, rows, BP, {"seq": (F.col("start"), F.col("end"))}).collect()
    assert sorted(x.seq for x in got) == ["", "", "", text["s5"][2:9]]


def exchanges(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    parts = re.split(r"\n\n+", df._jdf.queryExecution().explainString(mode))
    return [p for p in parts if re.match(r"\(\d+\) Exchange", p)]


def test_cut_bases_do_not_move(spark):
    text, chunks = sequences(spark)
    store = CS.write_chunk_store(chunks, buckets=3)
    moved = exchanges(IV.validate_introns(reported(spark, text), store, BP))
    assert moved and not any(re.search(r"\bpiece#", e) for e in moved)


def test_lines_are_not_gathered_by_file(spark, tmp_path):
    for i, head in enumerate(("Gene\tStatus\tSequence\tStrand\tCodons\n", "")):
        (tmp_path / f"t{i}.txt").write_text(head + "g1\tMissing\ts1\t+\t\ng1\tSingle\ts1\t+\t1_5_+\n" if head else "g1\tSingle\ts2\t0\t0\t-\n")
    df = TB.read_full_table(spark, str(tmp_path))
    assert not any(re.search(r"hashpartitioning\(file#\d+, \d+\)", e) and re.search(r"\bline_no#", e) for e in exchanges(df))
    assert sorted((r.gene, r.status, r.sequence_id, r.strand, len(r.exons)) for r in df.collect()) == [("g1", "Single", "s1", "+", 1), ("g1", "Single", "s2", "-", 0)]


def test_orthologs_start_from_models_formed_once(spark, data, monkeypatch):
    seen = []
    cut = IV.extract_cds
    monkeypatch.setattr(Q.IV, "extract_cds", lambda models, *rest: (seen.append(models), cut(models, *rest))[1])
    Q.orthologs(spark, data)
    assert len(seen) == 1 and not exchanges(seen[0])
