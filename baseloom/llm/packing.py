"""Packing by power-of-two decomposition.

A document of n tokens (its end token included) is cut into pieces whose lengths are the powers of two that sum
up to n, with as many of the longest as needed. Each piece is a sequence of its own, so no sequence holds
two documents and none needs padding. Sequences of one length form a bucket; their ids are grouped by bucket.
One pass over the texts, without a shuffle.

Defined cases: a null or empty text is one piece with the end token alone. Repeated rows are packed each on its
own. An empty table gives an empty result. Only id and text are read, other columns do not matter. A sequence
id is made of the bucket, the input partition and a running number there: a task that is run again gives the same.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baseloom.llm.registry import query, table
from baseloom.llm.tokens import CACHED_PIECES, END, encoder

MOST = 1024
_PART_BITS, _ROW_BITS = 20, 38


def lengths(n: int, most: int = MOST) -> list[int]:
    """Powers of two, falling, that sum up to n; ``most`` is the largest and a power of two."""
    out = [most] * (n // most)
    left, size = n % most, most // 2
    while left:
        if left >= size:
            out.append(size)
            left -= size
        size //= 2
    return out


def pack(documents: DataFrame, most: int = MOST, tokenizer: str | None = None, with_ids: bool = True, cached: int = CACHED_PIECES, keep: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the token ids (uint32, little-endian).

    ``cached`` bounds the pieces whose ids a worker remembers; without ``keep`` it forgets them after each task, so that workers that stay
    hold nothing while other stages run. Both affect time and memory only.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length must be a power of two")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids binary" if with_ids else ""

    def run(batches):
        coder = encoder(tokenizer, cached)
        encode, part = coder.encode, TaskContext.get().partitionId()
        if part >> _PART_BITS:
            raise ValueError("too many input partitions for sequence ids")
        count = [0] * most.bit_length()
        end = np.uint32(END).tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 512):
                tokens = encode(texts.slice(at, 512).to_pylist())
                row, start, size, crc, total, seq, data = [], [], [], [], [], [], []
                for i, t in enumerate(tokens):
                    t += end
                    n, begin = len(t) // 4, 0
                    for k in lengths(n, most):
                        piece = t[begin * 4 : (begin + k) * 4]
                        bucket = k.bit_length() - 1
                        seq.append(((bucket << _PART_BITS | part) << _ROW_BITS) + count[bucket])
                        count[bucket] += 1
                        row.append(at + i), start.append(begin), size.append(k), total.append(n), crc.append(zlib.crc32(piece))
                        if with_ids:
                            data.append(piece)
                        begin += k
                columns = [ids.take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, size, crc, total, seq)), pa.array(np.zeros(len(row), "i8"))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(data, pa.binary())] if with_ids else [])], names=[c.split()[0] for c in schema.split(", ")])
        if not keep:
            coder.forget()

    return documents.select("doc_id", F.col("text")).mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces one folder per sequence length, so that a batch reads sequences of equal length."""
    pieces.write.partitionBy("length").parquet(path)


@query("op8_packing")
def op8_packing(spark, d):
    return pack(table(spark, d, "documents"), with_ids=False)
