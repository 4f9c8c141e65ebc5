"""Token ids as files: documents compressed one by one with a shared zstandard dictionary.

A store is a folder. ``dictionary`` holds the dictionary and its SHA-256; ``blocks`` holds one row per block
of documents in ascending id order: the shard and its place there, first and last id, per document its id, place in
the payload, bytes per token and number of tokens, the dictionary's hash, and the payload of concatenated frames. The
Parquet files are written by Spark's committer in the shared folder, so lost executors cost a task, not the store. A short
document is read by its block's index: range filters on first and last id, one frame decompressed.

The dictionary is trained on a sample whose bound is ``SAMPLE`` documents of at most ``SAMPLE_CHARS`` characters each; it only
affects sizes. All documents are encoded whole.

Documents are encoded and compressed where they are read; only ids and frames, a fraction of the texts, are sorted by id.

Defined cases: a null or empty text has the end token alone. Null ids come first, equal ids in the order of their numbers of tokens, then
of their frames' bytes. An empty table gives an empty store; too few samples give an empty dictionary. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baseloom.llm.registry import query, staged, table
from baseloom.llm.tokens import END, encoder
from baseloom.session import scratch_path

SAMPLE, SAMPLE_CHARS = 600, 20_000
DICTIONARY_BYTES = 65_536
LEVEL = 3
BLOCK_TOKENS = 500_000
_BLOCK = (
    "shard int, place int, first long, last long, doc_ids array<long>, offsets array<long>, widths array<int>, "
    "counts array<long>, tokens long, dictionary string, payload binary"
)


def _ids(data: bytes) -> tuple[bytes, int]:
    """Ids as 16-bit numbers where all fit, and the bytes per id."""
    ids = np.frombuffer(data, "<u4")
    return (ids.astype("<u2").tobytes(), 2) if not len(ids) or ids.max() < 65536 else (data, 4)


def _encoded(batches, tokenizer):
    encode, end = encoder(tokenizer).encode, np.uint32(END).tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part.column(0).to_pylist(), [t + end for t in encode(part.column(1).to_pylist())]


def train_dictionary(documents: DataFrame, tokenizer: str | None = None) -> bytes:
    """A dictionary from a bounded sample of serialized id arrays, chosen by hash; empty if the sample is too small."""
    import zstandard

    def run(batches):
        for _, tokens in _encoded(batches, tokenizer):
            yield pa.RecordBatch.from_arrays([pa.array([_ids(t)[0] for t in tokens], pa.binary())], names=["data"])

    chosen = (
        documents.select("doc_id", "text", F.length("text").alias("n"))
        .where(F.col("n").between(1, SAMPLE_CHARS))
        .withColumn("h", F.xxhash64("doc_id", "n"))
        .orderBy("h", "doc_id", "text")
        .limit(SAMPLE)
        .select("doc_id", "text")
    )
    samples = sorted(bytes(r.data) for r in chosen.mapInArrow(run, "data binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_store(documents: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode all documents and write the store to a new folder."""
    spark = documents.sparkSession
    words = train_dictionary(documents, tokenizer)
    digest = hashlib.sha256(words).hexdigest()
    shared = spark.createDataFrame([(digest, bytearray(words))], "hash string, data binary")
    shared.write.parquet(f"{path}/dictionary")

    def encode(batches):
        import zstandard

        given = zstandard.ZstdCompressionDict(words) if words else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=given).compress
        for ids, tokens in _encoded(batches, tokenizer):
            packed = [_ids(t) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) // 4 for t in tokens], pa.int64()), pa.array([w for _, w in packed], pa.int32()), pa.array([compress(x) for x, _ in packed], pa.binary())],
                names=["doc_id", "n", "width", "frame"],
            )

    def run(batches):
        from pyspark import TaskContext

        shard, place = TaskContext.get().partitionId(), 0
        keys, offsets, widths, counts, payload, held, at = [], [], [], [], [], 0, 0

        def block():
            known = [k for k in keys if k is not None]
            row = [shard, place, known[0] if known else None, known[-1] if known else None, keys, offsets, widths, counts, held, digest, b"".join(payload)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for key, n, width, frame in zip(*(batch.column(c) for c in range(4))):
                frame, n = frame.as_py(), n.as_py()
                keys.append(key.as_py()), offsets.append(at), widths.append(width.as_py()), counts.append(n), payload.append(frame)
                at, held = at + len(frame), held + n
                if held >= BLOCK_TOKENS:
                    yield block()
                    place += 1
                    keys, offsets, widths, counts, payload, held, at = [], [], [], [], [], 0, 0
        if keys:
            yield block()

    frames = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n long, width int, frame binary")
    # Written once: the range bounds are sampled from it, and the sort reads it again.
    frames = staged(frames, "frames")
    ordered = frames.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "frame")
    ordered.mapInArrow(run, _BLOCK).write.parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.schema("hash string, data binary").parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.data)).hexdigest() != row.hash:
        raise ValueError("the dictionary does not match its hash")
    return row.hash, bytes(row.data)


def read_store(spark: SparkSession, path: str, only: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids.

    ``only`` names documents; then blocks without them are skipped, and of the others only their frames are read.
    """
    digest, words = _dictionary(spark, path)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    # One row per shard: where it starts.
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("shard_start"))
    before = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "place", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("here")).join(shards, "shard")
    starts = starts.select(F.col("shard").alias("s"), F.col("place").alias("p"), (F.col("here") + F.col("shard_start")).alias("begin"))
    if only is not None:
        blocks = blocks.where(F.exists(F.array(*[F.lit(int(i)) for i in only]), lambda i: (i >= F.col("first")) & (i <= F.col("last"))))
    placed = blocks.join(starts, (F.col("shard") == F.col("s")) & (F.col("place") == F.col("p")))
    wanted = None if only is None else set(only)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).decompress
        for batch in batches:
            for r in range(batch.num_rows):
                ids, offsets, widths, counts, used, payload, begin = (batch.column(c)[r].as_py() for c in range(7))
                if used != digest:
                    raise ValueError("a block was written with another dictionary")
                out = []
                for i, key in enumerate(ids):
                    if wanted is None or key in wanted:
                        end = offsets[i + 1] if i + 1 < len(offsets) else len(payload)
                        data = unpack(payload[offsets[i] : end])
                        data = np.frombuffer(data, f"<u{widths[i]}").astype("<u4").tobytes()
                        if len(data) != 4 * counts[i]:
                            raise ValueError(f"document {key} has not the length its index says")
                        out.append((key, begin, counts[i], zlib.crc32(data), data))
                    begin += counts[i]
                columns = list(zip(*out)) or [()] * 5
                arrays = [pa.array(columns[c], pa.int64()) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(columns[4], pa.binary())] if with_ids else [])], names=[c.split()[0] for c in schema.split(", ")])

    return placed.select("doc_ids", "offsets", "widths", "counts", "dictionary", "payload", "begin").mapInArrow(run, schema)


@query("op6_token_store")
def op6_token_store(spark, d):
    path = scratch_path(spark, "llm-tokens")
    write_store(table(spark, d, "documents"), path)
    return read_store(spark, path, with_ids=False)
