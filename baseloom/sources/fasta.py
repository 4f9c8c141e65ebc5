"""FASTA files as distributed tables of sequence chunks."""

from __future__ import annotations

import glob
import gzip
import io
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from baseloom.session import stored

BLOCK_BYTES = 32 * 1024 * 1024
SLAB_BYTES = 4 * 1024 * 1024
# The first step of the search for a line's start.
LOOK_BACK = 64 * 1024
# More tasks than this are formed only of whole blocks of ``BLOCK_BYTES``.
MANY_TASKS = 256
# File suffixes of alignments and genomes.
FASTA_SUFFIXES = (".fa", ".faa", ".fasta", ".fas", ".fna")

# Rows and bytes of text that a batch of the reader holds at most (or one slab).
BATCH_ROWS, BATCH_BYTES = 8192, 1024 * 1024

SEGMENT_SCHEMA = "file string, begin bigint, offset bigint, name string, record bigint, start0 bigint, n_bases bigint, bases string"


class FastaSegments(DataSource):
    """Byte ranges of FASTA files as rows of at most one slab of bases.

    ``begin`` is where the range starts, ``record`` numbers the headers met in it (0: before the first), ``name``
    is the last of them and ``start0`` counts the bases since it, or since the range began.

    Options: ``path`` (file, folder or pattern), ``block`` (bytes per range),
    ``rows``: ``bases`` (the default), ``lengths`` (without the text) or ``ends`` (one row per range: the state at its end).
    """

    @classmethod
    def name(cls) -> str:
        return "fasta_segments"

    def schema(self) -> str:
        return SEGMENT_SCHEMA

    def reader(self, schema):
        return _SegmentReader(self.options)


class _Ranges(InputPartition):
    def __init__(self, ranges):
        super().__init__(0)
        self.ranges = ranges


class _SegmentReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.block = int(options.get("block", BLOCK_BYTES))
        self.slab = int(options.get("slab", SLAB_BYTES))
        self.rows = options.get("rows", "bases")

    def partitions(self):
        """Large files are split into ranges. A task takes several ranges where they are many, so that their number
        does not grow with the bytes while a task has less than ``BLOCK_BYTES``."""
        files = list_files(self.path)
        task = max(self.block, min(BLOCK_BYTES, sum(size for _, size in files) // MANY_TASKS))
        parts, shared, room = [], [], task
        for path, size in files:
            if path.endswith(".gz"):
                parts.append(_Ranges([(path, 0, None)]))
                continue
            for a in range(0, size, self.block):
                b = min(a + self.block, size)
                if b - a > room and shared:
                    parts.append(_Ranges(shared))
                    shared, room = [], task
                shared.append((path, a, b))
                room -= b - a
        if shared:
            parts.append(_Ranges(shared))
        return parts or [_Ranges([])]

    def read(self, partition):
        rows, held = [], 0
        for row in self._rows(partition.ranges):
            rows.append(row)
            held += len(row[3] or "") + len(row[7] or "")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, ranges):
        for path, begin, end in ranges:
            record, name, start0, found = 0, None, 0, False
            for offset, header, bases in _segments(path, begin, end, self.slab):
                found = True
                if header is not None:
                    record, name, start0 = record + 1, header, 0
                if self.rows != "ends":
                    yield path, begin, offset, name, record, start0, len(bases), bases.decode("ascii") if self.rows == "bases" else None
                start0 += len(bases)
            if found and self.rows == "ends":
                yield path, begin, begin, name, record, start0, 0, None


def _batch(rows: list[tuple]):
    import pyarrow as pa

    names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in SEGMENT_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)


def _filesystem(path: str):
    """Filesystem and path for a URI; None for plain paths."""
    if "://" not in path and not path.startswith("file:"):
        return None, path
    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """FASTA files below a folder, of a pattern, or the one file; sorted."""
    system, local = _filesystem(path)
    if system is not None:
        from pyarrow import fs

        info = system.get_file_info(local)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        scheme = path.split("://")[0]
        found = system.get_file_info(fs.FileSelector(local, recursive=True))
        return sorted((f"{scheme}://{f.path}", f.size) for f in found if f.type == fs.FileType.File and _is_fasta(f.path))
    if os.path.isdir(local):
        names = [os.path.join(r, n) for r, _, ns in os.walk(local) for n in ns if _is_fasta(n)]
    else:
        names = glob.glob(local)
    return sorted((n, os.path.getsize(n)) for n in names)


def _is_fasta(name: str) -> bool:
    low = name.lower()
    return low.endswith(FASTA_SUFFIXES) or low.endswith(tuple(s + ".gz" for s in FASTA_SUFFIXES))


def _open(path: str):
    system, local = _filesystem(path)
    raw = open(local, "rb") if system is None else io.BufferedReader(system.open_input_file(local))
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def _line_before(f, begin: int) -> tuple[bool, bool]:
    """Whether a line starts at ``begin``, and if not, whether the line around it is a header.

    Reads back in growing steps to the start of the line, however long it is, and leaves the file at ``begin``.
    """
    at, step, first = begin, LOOK_BACK, b""
    while at:
        back = max(0, at - step)
        f.seek(back)
        before = f.read(at - back)
        cut = before.rfind(b"\n")
        if at == begin and cut == len(before) - 1:
            return True, False
        if cut >= 0:
            first = before[cut + 1 : cut + 2] or first
            break
        at, step, first = back, min(2 * step, SLAB_BYTES), before[:1]
    f.seek(begin)
    return begin == 0, first == b">"


def _segments(path: str, begin: int, end: int | None, slab_bytes: int):
    """(offset, header or None, bases) of one byte range.

    A header belongs to the range its first byte is in; a range that starts
    inside a line looks back to see what kind of line it is.
    """
    with _open(path) as f:
        line_start, skip = _line_before(f, begin)
        position, header, header_at = begin, None, begin
        while end is None or position < end:
            slab = f.read(slab_bytes if end is None else min(slab_bytes, end - position))
            if not slab:
                break
            size, i = len(slab), 0
            if skip:
                cut = slab.find(b"\n")
                if cut < 0:
                    position += size
                    continue
                i, skip, line_start = cut + 1, False, True
            while i < size:
                if line_start and slab[i : i + 1] == b">":
                    if header is not None:
                        yield header_at, header, b""
                    cut = slab.find(b"\n", i)
                    text = slab[i + 1 : cut] if cut >= 0 else slab[i + 1 :] + f.readline()
                    header, header_at = text.decode("utf-8", "replace").strip(), position + i
                    if cut < 0:
                        # The rest of the header was read past the slab.
                        size = f.tell() - position
                        i = size
                    else:
                        i = cut + 1
                    continue
                cut = slab.find(b"\n>", i)
                stop = cut + 1 if cut >= 0 else len(slab)
                bases = slab[i:stop].translate(None, b"\n\r\t ")
                if bases or header is not None:
                    yield (header_at if header is not None else position + i), header, bases
                    header = None
                line_start = slab[stop - 1 : stop] == b"\n"
                i = stop
            position += size
        if header is not None:
            yield header_at, header, b""


def read_segments(spark: SparkSession, path: str, block: int | None = None, rows: str = "bases", slab: int | None = None) -> DataFrame:
    spark.dataSource.register(FastaSegments)
    reader = spark.read.format("fasta_segments").option("path", path).option("rows", rows)
    if block:
        reader = reader.option("block", str(block))
    if slab:
        reader = reader.option("slab", str(slab))
    return reader.load()


def place_ranges(ends: DataFrame) -> DataFrame:
    """What precedes each byte range in its file: records, bases of the record it begins in, and that record's header.

    One narrow row per range goes through the windows; segments and bases are never sorted by file.
    """
    in_file = Window.partitionBy("file").orderBy("begin")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Ranges from one with a header to the next: their last bases belong to one record.
    same = Window.partitionBy("file", "_group").orderBy("begin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = ends.select(
        "file",
        "begin",
        "start0",
        F.coalesce(F.sum("record").over(before), F.lit(0)).alias("_records"),
        F.last("name", ignorenulls=True).over(before).alias("_name"),
        F.count_if(F.col("record") > 0).over(upto).alias("_group"),
    )
    summed = grouped.withColumn("_sum", F.sum("start0").over(same))
    return summed.select("file", "begin", "_records", "_name", F.coalesce(F.lag("_sum").over(in_file), F.lit(0)).alias("_bases"))


def placed_segments(spark: SparkSession, path: str, block: int | None, slab: int | None, rows: str = "bases") -> DataFrame:
    """Segments with the number, header and place in its record, from what precedes their range."""
    ranges = stored(place_ranges(read_segments(spark, path, block, "ends", slab)))
    carried = F.col("record") == 0
    return read_segments(spark, path, block, rows, slab).join(ranges, ["file", "begin"]).select(
        "file",
        "offset",
        (F.col("_records") + F.col("record")).alias("record_no"),
        F.when(carried, F.col("_name")).otherwise(F.col("name")).alias("long_name"),
        (F.col("start0") + F.when(carried, F.col("_bases")).otherwise(0)).alias("start0"),
        "n_bases",
        "bases",
    )


def _sequence_id(header):
    return F.regexp_extract(header, r"^(\S*)", 1)


def fasta_catalogue(spark: SparkSession, path: str, block: int | None = None, slab: int | None = None) -> DataFrame:
    """File, identifier (first word), full header and length of each record."""
    placed = placed_segments(spark, path, block, slab, "lengths")
    return placed.where("record_no > 0").groupBy("file", "record_no", "long_name").agg(
        F.sum("n_bases").alias("sequence_length")
    ).select("file", "record_no", _sequence_id(F.col("long_name")).alias("sequence_id"), "long_name", "sequence_length")


def read_fasta_chunks(
    spark: SparkSession, path: str, chunk_bp: int = 300_000, block: int | None = None, slab: int | None = None
) -> DataFrame:
    """Genome FASTA as rows of ``chunk_bp`` bases: file, record, identifier, chunk number."""
    segments = placed_segments(spark, path, block, slab).where("record_no > 0 AND n_bases > 0")
    end0 = F.col("start0") + F.col("n_bases")
    pieces = (
        segments.withColumn(
            "chunk_no",
            F.explode(F.sequence(F.floor(F.col("start0") / chunk_bp).cast("bigint"), F.floor((end0 - 1) / chunk_bp).cast("bigint"))),
        )
        .withColumn("_from", F.greatest(F.col("chunk_no") * chunk_bp, F.col("start0")))
        .withColumn("_to", F.least((F.col("chunk_no") + 1) * chunk_bp, end0))
        .withColumn(
            "piece",
            F.substring("bases", (F.col("_from") - F.col("start0") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")),
        )
    )
    parts = F.array_sort(F.collect_list(F.struct("_from", "piece")))
    return pieces.groupBy("file", "record_no", "long_name", "chunk_no").agg(
        F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("bases")
    ).withColumn("sequence_id", _sequence_id(F.col("long_name")))


def _whole_records(spark: SparkSession, path: str, block: int | None, slab: int | None) -> DataFrame:
    """Whole short records (genes, aligned sequences)."""
    parts = F.array_sort(F.collect_list(F.struct("start0", "bases")))
    return (
        placed_segments(spark, path, block, slab)
        .groupBy("file", "record_no", "long_name")
        .agg(F.array_join(F.transform(parts, lambda p: p["bases"]), "").alias("seq"))
        .withColumn("id", _sequence_id(F.col("long_name")))
        .withColumn("seq", F.upper("seq"))
    )


def read_gene_fasta(spark: SparkSession, path: str, block: int | None = None, slab: int | None = None) -> DataFrame:
    """Gene FASTA by first header word; gaps removed, the last of equal names counts."""
    rows = _whole_records(spark, path, block, slab).where("record_no > 0").withColumn(
        "seq", F.replace("seq", F.lit("-"), F.lit(""))
    )
    best = rows.groupBy("file", "id").agg(F.max(F.struct("record_no", "seq")).getField("seq").alias("seq"))
    return best.withColumnRenamed("id", "gene")


def read_alignments(spark: SparkSession, path: str, block: int | None = None, slab: int | None = None) -> DataFrame:
    """Aligned FASTA files of a folder: ``alignment, sequence_id, seq``.

    Repeated names, empty headers and bases before the first header are errors.
    """
    lengths = (
        placed_segments(spark, path, block, slab, "lengths")
        .groupBy("file", "record_no", "long_name")
        .agg(F.sum("n_bases").alias("w"))
        .withColumn("id", _sequence_id(F.col("long_name")))
    )
    bad = (
        lengths.groupBy("file", "id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("record_no").alias("r"), F.max("w").alias("w"))
        .where("n > 1 OR (r = 0 AND w > 0) OR (r > 0 AND id = '')")
        .orderBy("file", "id")
        .limit(5)
        .collect()
    )
    if bad:
        raise ValueError("; ".join(f"{r['file']}: bad record {r['id']!r}" for r in bad))
    name = F.element_at(F.split("file", "/"), -1)
    return _whole_records(spark, path, block, slab).where("record_no > 0").select(name.alias("alignment"), F.col("id").alias("sequence_id"), "seq")
