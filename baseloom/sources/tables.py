"""Delimited tables, id lists, JSON summaries and gene tables."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baseloom.operators.ranking import dedupe_last

# Tables written in chunks, whose single file is stale beside chunks.
CHUNKED_TABLES = ["genomic_windows", "gc_window_stats", "sequence_summary", "genome_summary"]

ASSEMBLY_SCHEMA = (
    "accession string, organism struct<organism_name: string, tax_id: bigint>, "
    "assembly_info struct<assembly_name: string, assembly_level: string, refseq_category: string>"
)
STATISTICS_SCHEMA = (
    "accession string, assemblyStats struct<totalNumberOfChromosomes: string, numberOfScaffolds: string, "
    "numberOfContigs: string, numberOfComponentSequences: string>"
)
# Column order of gene tables without a header line.
GENE_TABLE_LAYOUT = [
    "Gene",
    "Status",
    "Sequence",
    "Score",
    "Length",
    "Strand",
    "Col7",
    "Col8",
    "Col9",
    "Gene Start",
    "Gene End",
    "Col12",
    "Codons",
]
# Column order of the eight-column gene table.
SHORT_LAYOUT = ["Gene", "Status", "Sequence", "Gene Start", "Gene End", "Strand", "Score", "Length"]


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a pattern, on any file system Spark knows."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in (found or []) if s.isFile())


def _first_line(spark: SparkSession, path: str) -> str:
    """First line of a plain or compressed file; reads no more than that."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).open(where)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        text = codec.createInputStream(stream) if codec is not None else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
    finally:
        stream.close()
    return (line or "").lstrip("﻿")


def separator_of(spark: SparkSession, path: str) -> str:
    """Tab or comma by suffix, else by the first line."""
    low = path.lower().removesuffix(".gz")
    if low.endswith((".tsv", ".txt")):
        return "\t"
    if low.endswith(".csv"):
        return ","
    line = _first_line(spark, (_paths(spark, path) or [path])[0])
    return "\t" if line.count("\t") >= max(1, line.count(",")) else ","


def read_delimited(spark: SparkSession, path: str, schema=None, null: str = "") -> DataFrame:
    """Table with header; a byte-order mark before the first column is dropped."""
    reader = spark.read.option("header", True).option("sep", separator_of(spark, path)).option("escape", '"')
    reader = reader.option("nullValue", null)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


def _below(spark: SparkSession, folder: str) -> list[str]:
    """All table files below a folder, chunk folders included."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found, files = [], system.listFiles(path, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    endings = tuple(s + z for s in (".tsv", ".csv", ".txt") for z in ("", ".gz"))
    return sorted(f for f in found if f.endswith(endings) and not f.rsplit("/", 1)[-1].startswith(("_", ".")))


def table_files(spark: SparkSession, root: str, table: str) -> list[str]:
    """Files of one table: chunks win for chunked tables, else both count."""
    single = _below(spark, f"{root}/{table}.tsv")
    chunks = _below(spark, f"{root}/{table}")
    return chunks if table in CHUNKED_TABLES and chunks else single + chunks


def headers(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, header`` of each file that is not empty: its first line, without a byte-order mark.

    One job over the files, so that the driver opens none.
    """
    lines = read_lines(spark, files).where("line_no.block = 0")
    first = lines.groupBy("file").agg(F.min(F.struct("line_no", "value"))["value"].alias("header"))
    return first.select("file", F.regexp_replace("header", "^\ufeff|\r$", "").alias("header"))


def scan_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All files of a table; files of equal header are read together, gaps are NULL.

    The driver gets the names of the files by header, as many as its listing holds. Files without a line count for nothing.
    """
    files = table_files(spark, root, table)
    if not files:
        raise FileNotFoundError(f"no files for {table} below {root}")
    groups = headers(spark, files).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    parts = []
    for group in sorted(groups.collect(), key=lambda g: g["files"]):
        schema = ", ".join(f"`{c}` string" for c in group["header"].split("\t"))
        reader = spark.read.option("header", True).option("sep", "\t").option("nullValue", "\\N").option("escape", '"')
        # File names in the metadata are written as addresses.
        parts.append(reader.schema(schema).csv([unquote(f) for f in group["files"]]))
    if not parts:
        raise ValueError(f"no header line for {table} below {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with file and an order inside it.

    The order is the byte block, then the row inside the task's share of it.
    """
    return (
        spark.read.text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"),
        )
    )


def read_id_list(spark: SparkSession, path: str, first_word: bool = False) -> DataFrame:
    """Distinct ids, one per line; blank lines and ``#`` lines do not count."""
    text = F.trim("value")
    word = F.regexp_extract(text, r"^(\S+)", 1) if first_word else text
    return spark.read.text(path).where((text != "") & ~text.startswith("#")).select(word.alias("id")).distinct()


def read_gene_row(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a one-line comma list, one per row."""
    genes = F.transform(F.split("value", ","), lambda g: F.trim(g))
    return spark.read.text(path).select(F.explode(genes).alias("gene")).where("gene <> ''")


def read_ortholog_links(spark: SparkSession, path: str) -> DataFrame:
    """Ortholog links (three tab fields) from text files or a tar archive.

    A tar archive has no splits: the member is streamed by one task, line
    blocks at a time.
    """
    if path.lower().endswith((".tar", ".tar.gz", ".tgz")):
        files = spark.createDataFrame([(p,) for p in _paths(spark, path)], "path string")
        lines = files.mapInPandas(_tar_lines, "value string")
    else:
        lines = spark.read.option("recursiveFileLookup", True).text(path)
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) >= 3).select(
        parts[0].alias("odb12_id"), parts[1].alias("name"), parts[2].alias("orthodb")
    )


def _tar_lines(batches, member: str = "links_to_ODB12.txt", block: int = 50_000):
    import tarfile
    from itertools import islice

    import pandas as pd

    for batch in batches:
        for path in batch["path"]:
            with tarfile.open(path.removeprefix("file:"), "r:*") as tar:
                found = next((m for m in tar if m.name.endswith(member)), None)
                if found is None:
                    raise FileNotFoundError(f"{member} is not in {path}")
                lines = (raw.decode("utf-8").rstrip("\n") for raw in tar.extractfile(found))
                while part := list(islice(lines, block)):
                    yield pd.DataFrame({"value": part})


def read_assembly_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Assembly summaries by accession; the last line of an accession counts."""
    lines = read_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", ASSEMBLY_SCHEMA).alias("j"), "file", "line_no").select("j.*", "file", "line_no")
    return dedupe_last(parsed.where("accession <> ''"), ["accession"], ["file", "line_no"]).drop("file", "line_no")


def read_assembly_stats(spark: SparkSession, path: str) -> DataFrame:
    """The first report line per accession, flattened."""
    from baseloom.operators.catalog import assembly_statistics

    parsed = read_lines(spark, path).where(F.trim("value") != "").select(
        F.from_json("value", STATISTICS_SCHEMA).alias("j"), "file", "line_no"
    )
    first = parsed.groupBy("j.accession").agg(F.min(F.struct("file", "line_no", "j")).getField("j").alias("j"))
    return assembly_statistics(first.select("j.*"))


def _place(head: Column, names: list[str], default: int) -> Column:
    """Position of a column in a header line, by the first of ``names`` that it has; of equal ones the last.

    Exact names go before names without blanks and underscores.
    """
    fields = F.transform(F.split(head, "\t"), lambda c: F.lower(c))

    def packed(name: Column) -> Column:
        return F.translate(name, " _", "")

    def last(columns: Column, name: Column) -> Column:
        at = F.array_position(F.reverse(columns), name)
        return F.when(at > 0, F.size(columns) - at)

    exact = [last(F.transform(fields, lambda c: F.trim(c)), F.lit(n.lower())) for n in names]
    loose = [last(F.transform(fields, packed), packed(F.lit(n.lower()))) for n in names]
    return F.coalesce(*exact, *loose, F.lit(default)).cast("int")


def parse_full_table(lines: DataFrame, columns: list[str] | None = None, keys: tuple[str, ...] = (), head: str | None = None) -> DataFrame:
    """Gene models from gene-table lines (``value, line_no``, and ``keys``).

    The layout of a line is ``columns``, or its header line in the column ``head``, else the default.
    Exon tokens are ``start_end_strand``; ends are put in order, tokens of
    another form or strand are dropped and make ``valid`` false. Gene ends
    default to those of the exons. The last line of a gene counts.
    """
    layout = F.lit("\t".join(columns or GENE_TABLE_LAYOUT))
    if head is not None:
        layout = F.coalesce(F.col(head), layout)
    at = {
        "gene": _place(layout, ["Gene"], 0),
        "status": _place(layout, ["Status"], 1),
        "sequence_id": _place(layout, ["Sequence", "Chromosome", "Contig"], 2),
        "strand": _place(layout, ["Strand"], 5),
        "start": _place(layout, ["Gene Start", "Start"], 9),
        "end": _place(layout, ["Gene End", "End"], 10),
        "codons": _place(layout, ["Codons", "Coordinates", "Exons"], 12),
    }
    needed = F.greatest(*[at[c] for c in ("gene", "status", "sequence_id", "strand")])

    def field(name: str) -> Column:
        return F.coalesce(F.trim(F.get(F.split("value", "\t"), at[name])), F.lit(""))

    text = F.col("value")
    kept = lines.where((text != "") & ~text.startswith("#") & (F.lower(F.split(text, "\t")[0]) != "gene"))
    kept = kept.where(F.size(F.split("value", "\t")) > needed)
    rows = kept.select(*keys, "line_no", *[field(c).alias(c) for c in at]).where("gene <> ''")
    last = dedupe_last(rows, [*keys, "gene"], ["line_no"]).drop("line_no")
    tokens = F.split("codons", r"\|")
    parsed = F.expr(
        r"""transform(filter(_tokens, t -> size(split(t, '_')) = 3 AND split(t, '_')[0] RLIKE '^\\s*[+-]?\\d+\\s*$'
              AND split(t, '_')[1] RLIKE '^\\s*[+-]?\\d+\\s*$'),
            t -> named_struct(
              'start', least(bigint(trim(split(t, '_')[0])), bigint(trim(split(t, '_')[1]))),
              'end', greatest(bigint(trim(split(t, '_')[0])), bigint(trim(split(t, '_')[1]))),
              'strand', split(t, '_')[2]))"""
    )
    same = F.expr("array_sort(transform(filter(_parsed, e -> strand = '' OR e.strand = strand), e -> named_struct('start', e.start, 'end', e.end)))")
    with_exons = (
        last.withColumn("_tokens", F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != ""))
        .withColumn("_parsed", parsed)
        .withColumn("exons", same)
    )
    start, end = F.col("start").try_cast("double"), F.col("end").try_cast("double")
    broken = ((F.col("start") != "") & start.isNull()) | ((F.col("end") != "") & end.isNull())

    def bound(number: Column, fallback: Column) -> Column:
        return F.coalesce(F.when(~broken, number.cast("bigint")), F.when(F.size("exons") > 0, fallback))

    return with_exons.select(
        *keys,
        "gene",
        "status",
        "sequence_id",
        "strand",
        bound(start, F.array_min(F.transform("exons", lambda e: e["start"]))).alias("start"),
        bound(end, F.array_max(F.transform("exons", lambda e: e["end"]))).alias("end"),
        "exons",
        (F.size("exons") == F.size("_tokens")).alias("valid"),
    )


def read_full_table(spark: SparkSession, path: str, layout: list[str] | None = None) -> DataFrame:
    """Gene models of gene-table files, by ``file`` and gene.

    A file's layout is the given one, else that of its first header line, else the default. Each line meets its file's
    header by a join, so all files are parsed in one pass, whatever their headers. There is one row per file that has a header,
    and it goes to the lines: else all lines of a file would meet in one task.
    """
    lines = read_lines(spark, path)
    if layout is not None:
        return parse_full_table(lines, layout, ("file",))
    first = lines.where(F.lower(F.trim(F.split("value", "\t")[0])) == "gene").groupBy("file").agg(F.min(F.struct("line_no", "value"))["value"].alias("head"))
    return parse_full_table(lines.join(F.broadcast(first), "file", "left"), keys=("file",), head="head")
