"""Readers and writers on small files."""

import gzip
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from baseloom.operators.trees import ancestor_pairs
from baseloom.plans.divergence import divergence_tables
from baseloom.plans.features import feature_tables
from baseloom.plans.windows import export_window_tables, window_tables
from baseloom.sources import fasta as FA
from baseloom.sources import pages as PG
from baseloom.sources import sinks as SK
from baseloom.sources import tables as TB
from baseloom.sources import trees_text as TT
from workload import inputs as I

FASTA = ">one first record\nACGTAC\nGT\n\n>two\n>three | x > y\nNNNN\nAC\r\nGT"


@pytest.mark.parametrize("block", [1, 2, 3, 5, 8, 13, 1000])
@pytest.mark.parametrize("slab", [1, 4, 100])
def test_fasta_splits_anywhere(spark, tmp_path, block, slab):
    path = tmp_path / "a.fna"
    path.write_bytes(FASTA.encode())
    rows = []
    for begin in range(0, len(FASTA), block):
        rows += FA._segments(str(path), begin, min(begin + block, len(FASTA)), slab)
    records = []
    for _, header, bases in sorted(rows, key=lambda r: r[0]):
        if header is not None:
            records.append([header, b""])
        records[-1][1] += bases
    assert records == [["one first record", b"ACGTACGT"], ["two", b""], ["three | x > y", b"NNNNACGT"]]


@pytest.mark.parametrize("block", [10_000, 64 * 1024, 150_000])
def test_long_headers_over_blocks(tmp_path, block):
    """A header longer than the first look back is no sequence, a long line of bases is."""
    text = ">a " + "x" * 200_000 + "\nACGT\n>b\n" + "ACGT" * 50_000 + "\n"
    path = tmp_path / "a.fna"
    path.write_text(text)
    records = []
    for begin in range(0, len(text), block):
        for _, header, bases in FA._segments(str(path), begin, min(begin + block, len(text)), 7_000):
            if header is not None:
                records.append([header[:1], 0])
            records[-1][1] += len(bases)
    assert records == [["a", 4], ["b", 200_000]]


def test_fasta_records_over_many_ranges(spark, tmp_path):
    """Records that run over several ranges, headers without bases, and bases before the first header, in two files."""
    want = {}
    for file, lead in (("a.fa", "ACGT\nAC\n"), ("b.fa", "")):
        text, last = lead, {}
        for i in range(60):
            seq = "ACGTN"[: i % 5 + 1] * (i * i % 23 if i % 6 else 0)
            text += f">r{i % 50} n{i}\n" + "".join(seq[k : k + 10] + "\n" for k in range(0, len(seq), 10))
            last[f"r{i % 50}"] = seq
            want[file, i + 1] = (f"r{i % 50} n{i}", len(seq))
        want[file] = last
        (tmp_path / file).write_text(text)
    base = lambda r: os.path.basename(r["file"])
    for block, slab in ((37, 11), (100, 1000)):
        found = FA.fasta_catalogue(spark, str(tmp_path), block, slab).collect()
        assert len(found) == 120 and all(want[base(r), r["record_no"]] == (r["long_name"], r["sequence_length"]) for r in found)
        genes = FA.read_gene_fasta(spark, str(tmp_path), block, slab).collect()
        assert len(genes) == 100 and all(want[base(r)][r["gene"]] == r["seq"] for r in genes)


def test_short_records_share_batches_and_tasks(tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">g{i}\nACGT\n" for i in range(20_000)))
    reader = FA._SegmentReader({"path": str(tmp_path), "block": "100", "slab": "50"})
    parts = reader.partitions()
    assert len(parts) <= 2 * FA.MANY_TASKS
    sizes = [b.num_rows for p in parts for b in reader.read(p)]
    assert sum(sizes) >= 20_000 and len(sizes) == len(parts)


def test_fasta_chunks_and_gzip(spark, tmp_path):
    (tmp_path / "a.fna").write_text(FASTA)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">four\nAAAA\nCC\n")
    got = {(r["sequence_id"], r["chunk_no"]): r["bases"] for r in FA.read_fasta_chunks(spark, str(tmp_path), 5, 10, 4).collect()}
    assert got == {("one", 0): "ACGTA", ("one", 1): "CGT", ("three", 0): "NNNNA", ("three", 1): "CGT", ("four", 0): "AAAAC", ("four", 1): "C"}
    lengths = {r["sequence_id"]: r["sequence_length"] for r in FA.fasta_catalogue(spark, str(tmp_path), 10, 4).collect()}
    assert lengths == {"one": 8, "two": 0, "three": 8, "four": 6}


def test_alignment_errors(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x\nAC-\n>x\nACG\n")
    with pytest.raises(ValueError, match="bad record 'x'"):
        FA.read_alignments(spark, str(tmp_path))
    (tmp_path / "a.fasta").write_text("ACG\n>x\nac-\n")
    with pytest.raises(ValueError):
        FA.read_alignments(spark, str(tmp_path))
    (tmp_path / "a.fasta").write_text(">x y\nac-\n")
    row = FA.read_alignments(spark, str(tmp_path)).collect()[0]
    assert (row["alignment"], row["sequence_id"], row["seq"]) == ("a.fasta", "x", "AC-")


def test_separator_and_mark(spark, tmp_path):
    (tmp_path / "a.dat").write_text("﻿k\tv\n1\tx\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('k,v\n1,"x, y"\n')
    assert TB.separator_of(spark, str(tmp_path / "a.dat")) == "\t"
    assert TB.read_delimited(spark, str(tmp_path / "a.dat")).columns == ["k", "v"]
    assert TB.read_delimited(spark, str(tmp_path / "b.csv")).collect()[0]["v"] == "x, y"


def test_chunks_win_over_stale_file(spark, tmp_path):
    (tmp_path / "genome_summary.tsv").write_text("a\tb\nold\t1\n")
    os.mkdir(tmp_path / "genome_summary")
    with gzip.open(tmp_path / "genome_summary" / "c1.tsv.gz", "wt") as f:
        f.write("a\tb\nnew\t\\N\n")
    (tmp_path / "genome_summary" / "c2.tsv").write_text("a\tb\tc\nnewer\t2\t3\n")
    rows = {r["a"]: (r["b"], r["c"]) for r in TB.scan_table(spark, str(tmp_path), "genome_summary").collect()}
    assert rows == {"new": (None, None), "newer": ("2", "3")}


def test_scan_groups_files_by_header(spark, tmp_path):
    """Headers come from a job: marks, line ends, empty files and names with blanks and signs do no harm."""
    folder = tmp_path / "a b%20c" / "natural_history"
    os.makedirs(folder)
    (folder / "1.tsv").write_bytes("\ufeffa\tb\r\n1\t2\r\n".encode())
    (folder / "2.tsv").write_text("a\tb\n" + "".join(f"{i}\t{i}\n" for i in range(10, 500)))
    (folder / "3.tsv").write_text("c\ta\n7\t8\n")
    (folder / "4.tsv").write_text("")
    df = TB.scan_table(spark, str(tmp_path / "a b%20c"), "natural_history")
    assert df.columns == ["a", "b", "c"]
    got = {tuple(r) for r in df.collect()}
    assert got == {("1", "2", None), ("8", None, "7")} | {(str(i), str(i), None) for i in range(10, 500)}
    with pytest.raises(FileNotFoundError):
        TB.scan_table(spark, str(tmp_path), "no_such_table")
    os.makedirs(tmp_path / "void" / "natural_history")
    (tmp_path / "void" / "natural_history" / "1.tsv").write_text("")
    with pytest.raises(ValueError):
        TB.scan_table(spark, str(tmp_path / "void"), "natural_history")


def test_links_from_tar(spark, tmp_path):
    (tmp_path / "links_to_ODB12.txt").write_text("1at2\tname\turl\nbroken\n")
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "links_to_ODB12.txt", "deep/links_to_ODB12.txt")
    rows = TB.read_ortholog_links(spark, str(tmp_path / "x.tar.gz")).collect()
    assert [tuple(r) for r in rows] == [("1at2", "name", "url")]


def test_full_table_forms(spark, tmp_path):
    lines = ["# note", "Gene\tStatus\tSequence\tStrand\tGene Start\tGene End\tCodons", "g1\tSingle\tc\t-\t\t\t30_21_-|1_10_-|5_6_+|x"]
    (tmp_path / "t.tsv").write_text("\n".join(lines) + "\n")
    row = TB.read_full_table(spark, str(tmp_path / "t.tsv")).collect()[0]
    assert (row["start"], row["end"], row["valid"]) == (1, 30, False)
    assert [tuple(e) for e in row["exons"]] == [(1, 10), (21, 30)]
    (tmp_path / "s.tsv").write_text("# Busco id\nb1\tComplete\tc\t5\t9\t+\t1\t2\n")
    row = TB.read_full_table(spark, str(tmp_path / "s.tsv"), TB.SHORT_LAYOUT).collect()[0]
    assert (row["status"], row["start"], row["end"], row["strand"]) == ("Complete", 5, 9, "+")


def test_full_tables_of_several_files(spark, tmp_path):
    """Each file has its own layout, and equal genes of two files stay apart."""
    (tmp_path / "a.tsv").write_text("Gene\tStatus\tSequence\tStrand\tGene Start\tGene End\tCodons\ng1\tSingle\tc\t+\t1\t9\t1_9_+\n")
    (tmp_path / "b.tsv").write_text("Gene\tSequence\tStatus\tStrand\tCodons\tGene Start\tGene End\ng1\td\tSingle\t+\t3_5_+\t3\t5\n")
    (tmp_path / "c.tsv").write_text("g1\tSingle\te\t.\t.\t+\t.\t.\t.\t7\t8\t.\t7_8_+\n")
    rows = TB.read_full_table(spark, str(tmp_path)).collect()
    assert sorted((r["file"][-5:], r["gene"], r["sequence_id"], r["start"], r["end"], r["valid"]) for r in rows) == [
        ("a.tsv", "g1", "c", 1, 9, True), ("b.tsv", "g1", "d", 3, 5, True), ("c.tsv", "g1", "e", 7, 8, True)
    ]


def test_full_table_columns_by_loose_names(spark, tmp_path):
    """Names without blanks and underscores count after exact ones; of equal names the last column counts."""
    (tmp_path / "a.tsv").write_text("gene\tSTATUS\tContig\tstrand\tgene_start\tGeneEnd\tExons\tStatus\ng1\tno\tc\t+\t2\t9\t2_9_+\tSingle\n")
    rows = TB.read_full_table(spark, str(tmp_path / "a.tsv")).collect()
    assert [(r["gene"], r["status"], r["sequence_id"], r["start"], r["end"], r["valid"]) for r in rows] == [("g1", "Single", "c", 2, 9, True)]


def test_full_tables_are_read_in_one_pass(spark, tmp_path):
    """The number of scans does not grow with the number of headers."""
    for i in range(12):
        (tmp_path / f"{i}.tsv").write_text("Gene\tStatus\tSequence\tStrand\tCodons" + f"\tx{i}\n" + f"g{i}\tSingle\tc\t+\t1_9_+\t0\n")
    df = TB.read_full_table(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    assert sorted((r["gene"], r["end"]) for r in df.collect()) == sorted((f"g{i}", 9) for i in range(12))


def test_cycle_is_an_error(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "child string, parent string")
    with pytest.raises(ValueError, match="its own ancestor"):
        ancestor_pairs(edges)


def test_page_parts(spark):
    html = "<h1> </h1><h2>Genus &amp; sp</h2><script>1C 9</script><p>C-value: 2.30 and 1C 2.30, 4 pg</p>"
    df = spark.createDataFrame([(1, "more", html)], "page_id int, link_text string, html string")
    row = PG.extract_c_values(df).collect()[0]
    assert (row["species_name"], row["c_values_pg_detected"], row["n_c_values_detected"]) == ("Genus & sp", "2.30;4", 2)


def test_load_modes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    new = spark.createDataFrame([("2", "x", 0), ("3", "y", 1), ("3", "z", 2)], "k string, v string, o int")
    with pytest.raises(ValueError, match="repeated keys"):
        SK.load_table(target, new, ["k"], "insert")
    assert {(r["k"], r["v"]) for r in SK.load_table(target, new, ["k"], "ignore", "o").collect()} == {(1, "a"), (2, "b"), (3, "y")}
    assert {(r["k"], r["v"]) for r in SK.load_table(target, new, ["k"], "replace", "o").collect()} == {(1, "a"), (2, "x"), (3, "z")}


def test_window_plan(spark, data, tmp_path):
    chunks, seqs, genomes = I.chunks(spark, data), I.seqs(spark, data).drop("bases"), I.genomes(spark, data)
    out = window_tables(chunks, seqs, genomes, str(tmp_path / "w"), sizes=[600, 300], types=["chromosome"], chunk_bp=I.CHUNK_BP)
    summary = {(r["genome_pk"], r["standard_window_size_bp"]): r["n_windows_total"] for r in out["genome_summary"].collect()}
    counted = {(r[0], r[1]): r[2] for r in out["windows"].groupBy("genome_pk", "standard_window_size_bp").count().collect()}
    assert {k: v for k, v in summary.items() if v} == counted
    manifest = export_window_tables(out, genomes, str(tmp_path / "x"), 1)["genome_summary"]
    assert manifest.agg(F.sum("n_rows")).collect()[0][0] == len(summary)


def test_feature_plan(spark, data):
    out = feature_tables(I.models(spark, data), I.chunks(spark, data, I.SLICE_BP), I.seqs(spark, data).drop("bases"), I.genomes(spark, data), I.SLICE_BP)
    n = out["orthologs"].count()
    keys = out["orthologs"].agg(F.min("ortholog_pk"), F.max("ortholog_pk"), F.countDistinct("ortholog_pk")).collect()[0]
    assert tuple(keys) == (1, n, n)
    assert out["flank_summary"].agg(F.sum("n_flanks")).collect()[0][0] == out["flanks"].count()


def test_divergence_plan(spark):
    trees = spark.createDataFrame([("g1.tree", "((a x 40.0:0.1,b_y 42.0:0.1)41.0:0.2);")], "name string, text string")
    lks = spark.createDataFrame([("g1.lk", "Ancestral GC 0.45\n")], "name string, text string")
    edges = spark.createDataFrame([("x", "node_3"), ("b_y", "node_3"), ("node_3", "ancestral")], "child string, parent string")
    gc4 = spark.createDataFrame([("b_y", 0.5, None)], "genus_species string, mean_gc4 double, sd_gc4 double")
    meta = spark.createDataFrame([("b_y", "nan", "b_y")], "genus_species string, accession string, manifest_merge_key string")
    out = divergence_tables(trees, lks, edges, 2, gc4, meta, strict=True)
    assert {(r["child"], r["dij"]) for r in out["dij"].collect()} == {("x", 1.0), ("b_y", 1.0), ("node_3", 4.0)}
    row = {r["genus_species"]: r for r in out["master"].collect()}["b_y"]
    assert (row["dianc"], row["accession"], row["mean_gc4"], row["sd_gc3"]) == (3.0, None, 0.5, None)


def test_wide_edges_of_any_number(spark, tmp_path):
    """More children than a pivot allows; names with commas and quotes; pieces of bounded width in order."""
    edges = spark.range(10_050).select(F.format_string("tip%05d", "id").alias("child"), F.concat(F.lit("node_"), F.col("id") % 7).alias("parent"))
    odd = spark.createDataFrame([('a "b", c', "node_1"), ("tip00000", "node_0"), ("tip00001", "node_0"), ("lost", None)], "child string, parent string")
    pieces = SK.edges_wide(edges.unionByName(odd)).collect()
    assert len(pieces) == 22 and {r.line for r in pieces} == {0, 1}
    assert max(r.value.count(",") for r in pieces) <= 1_001
    got = {(r.child, r.parent) for r in TT.wide_edges(SK.edges_wide(edges.unionByName(odd))).collect()}
    want = TT.node_edges(edges.unionByName(odd).groupBy("child").agg(F.min("parent").alias("parent")))
    assert got == {(r.child, r.parent) for r in want.collect()} and len(got) == 10_051
    SK.write_edges_wide(edges, str(tmp_path / "wide"))
    texts = [",".join(f.read_text().rstrip("\n").replace("\n", ",") for f in sorted((tmp_path / "wide" / f"line={i}").glob("part-*"))).split(",") for i in (0, 1)]
    assert list(zip(*texts)) == [(f"tip{i:05d}", f"node_{i % 7}") for i in range(10_050)]
    narrow = spark.createDataFrame([("node_1", "ancestral")], "tip1 string, node_1 string")
    assert {(r.child, r.parent) for r in TT.node_edges(narrow).collect()} == {("tip1", "node_1"), ("node_1", "ancestral")}
