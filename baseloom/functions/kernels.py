"""Arrow kernels for counting bases.

Counting six bases by string functions walks each text six times at some 100 ns
per base; numpy over the Arrow buffer of a whole batch needs about 3 ns. The
kernels see one batch at a time and keep no state; Spark splits, shuffles and
adds up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# Counted characters, in the order of the count columns.
COUNTED = "ACGTN-"
COUNT_NAMES = ["a_count", "c_count", "g_count", "t_count", "n_count", "gap_bp"]
COUNT_TYPE = StructType([StructField(n, LongType()) for n in [*COUNT_NAMES, "total_bp"]])
# Bases that a kernel looks at together: its working memory is a multiple of this, not of a batch of 10,000 texts.
SLAB_BASES = 1 << 20


def _text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array, without copying."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), rows


def _slabs(rows: np.ndarray):
    """Row ranges of at most one slab of bases (or one row)."""
    begin, n = 0, len(rows) - 1
    while begin < n:
        end = int(np.searchsorted(rows, rows[begin] + SLAB_BASES, "right")) - 1
        end = min(max(end, begin + 1), n)
        yield begin, end
        begin = end


def _parts(data: np.ndarray, rows: np.ndarray):
    """(first row, last row, bytes, offsets) of each slab; a batch without rows is one empty slab."""
    for begin, end in list(_slabs(rows)) or [(0, 0)]:
        yield begin, end, data[rows[begin] : rows[end]], rows[begin : end + 1] - rows[begin]


def translated(text: pa.Array, table: bytes, dropped: bytes) -> pa.Array:
    """Texts by a byte table to ASCII, without the dropped bytes; NULL stays NULL."""
    kept = np.ones(256, bool)
    kept[list(dropped)] = False
    data, rows = _text_buffer(text.fill_null(""))
    out, ends = bytearray(), [np.zeros(1, np.int64)]
    for _, _, part, local in _parts(data, rows):
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(kept[part], out=total[1:])
        ends.append(total[local[1:]] + len(out))
        out += part.tobytes().translate(table, dropped)
    texts = pa.StringArray.from_buffers(len(text), pa.py_buffer(np.concatenate(ends).astype(np.int32)), pa.py_buffer(out))
    return pa.compute.if_else(text.is_valid(), texts, None) if text.null_count else texts


def _counts_between(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Counts of each counted character in the ranges, upper and lower case."""
    upper = data & 0xDF if not np.any(data == ord("-")) else np.where(data >= 0x60, data & 0xDF, data)
    out = []
    for char in COUNTED:
        hits = (data if char == "-" else upper) == ord(char)
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(hits, dtype=np.int32, out=total[1:])
        out.append((total[stops] - total[starts]).astype(np.int64))
    return out


@F.arrow_udf(COUNT_TYPE)
def base_counts(seq: pa.Array) -> pa.Array:
    """Base counts of each text of a batch; NULL counts as the empty text."""
    data, rows = _text_buffer(seq.fill_null(""))
    columns = [np.zeros(len(seq), np.int64) for _ in COUNT_NAMES]
    for begin, end in _slabs(rows):
        part = data[rows[begin] : rows[end]]
        local = rows[begin : end + 1] - rows[begin]
        for column, counts in zip(columns, _counts_between(part, local[:-1], local[1:])):
            column[begin:end] = counts
    columns.append(np.diff(rows))
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], [f.name for f in COUNT_TYPE])


# IUPAC nucleotide codes and their complements, both cases.
IUPAC = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
IUPAC_COMPLEMENT = "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
_COMPLEMENT = bytes.maketrans(IUPAC.encode(), IUPAC_COMPLEMENT.encode())


@F.arrow_udf(StringType())
def reverse_complement(seq: pa.Array) -> pa.Array:
    """Complement by a byte table, then reversed; case is kept."""
    turned = [None if t.as_py() is None else t.as_buffer().to_pybytes().translate(_COMPLEMENT)[::-1] for t in seq]
    return pa.array([None if t is None else t.decode("ascii") for t in turned], pa.string())


def window_counter(keys: list[str], pairs: list[tuple[int, int]], offset: int, chunk_bp: int):
    """A function for ``mapInArrow``: counts of each window's part on each chunk.

    A window that lies whole on one chunk gives one row; others one per chunk.
    """

    def run(batches):
        for batch in batches:
            data, rows = _text_buffer(batch.column("bases"))
            left_all = batch.column("chunk_no").to_numpy(zero_copy_only=False).astype(np.int64) * chunk_bp
            for begin, end in _slabs(rows):
                base = rows[begin]
                part, local = data[base : rows[end]], rows[begin : end + 1] - base
                left = left_all[begin:end]
                for size, step in pairs:
                    yield _window_batch(batch, keys, part, local, left, begin, size, step, offset)

    return run


def _window_batch(batch, keys, part, local, left, begin, size, step, offset):
    length = np.diff(local)
    right = left + length
    first = np.maximum(0, (left - offset - size) // step + 1)
    last = (right - 1 - offset) // step
    many = np.where(length > 0, np.maximum(0, last - first + 1), 0)
    row = np.repeat(np.arange(len(left)), many)
    rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[row]
    start = offset + rank * step
    lo = np.maximum(start, left[row]) - left[row]
    hi = np.minimum(start + size, right[row]) - left[row]
    keep = hi > lo
    row, rank, lo, hi = row[keep], rank[keep], lo[keep], hi[keep]
    counts = _counts_between(part, local[row] + lo, local[row] + hi)
    taken = pa.array(row + begin)
    arrays = [batch.column(k).take(taken) for k in keys]
    fixed = [np.full(len(row), v, np.int64) for v in (size, step)]
    arrays += [pa.array(a) for a in [*fixed, rank.astype(np.int64), *counts, (hi - lo).astype(np.int64)]]
    names = [*keys, "standard_window_size_bp", "step_size_bp", "window_rank0", *COUNT_NAMES, "total_bp"]
    return pa.RecordBatch.from_arrays(arrays, names=names)


# Two-base prefixes of the four-fold degenerate families.
FOURFOLD_PREFIXES = ["GT", "CC", "AC", "GC", "GG", "CT", "CG", "TC"]
_CODE = np.full(256, 4, np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_FAMILY = np.full(25, 255, np.int64)
for _i, _p in enumerate(FOURFOLD_PREFIXES):
    _FAMILY[_CODE[ord(_p[0])] * 5 + _CODE[ord(_p[1])]] = _i
# Ambiguous nucleotide codes.
_AMBIGUOUS = np.zeros(256, bool)
_AMBIGUOUS[[ord(c) for c in "NRYSWKMBDHV"]] = True


def _codons(data: np.ndarray, rows: np.ndarray):
    """Row, number in the row and first position of all complete codons."""
    many = np.diff(rows) // 3
    row = np.repeat(np.arange(len(many)), many)
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return many, row, number, rows[row] + number * 3


def _upper(data: np.ndarray) -> np.ndarray:
    return np.where((data >= ord("a")) & (data <= ord("z")), data - 32, data)


CDS_FIELDS = [
    "length", "internal_stops", "last_stop", "a", "c", "g", "t", "n", "ambiguous", "gc3", "valid3", "gc4", "valid4",
]
CDS_TYPE = StructType([StructField(n, LongType()) for n in CDS_FIELDS])


@F.arrow_udf(CDS_TYPE)
def cds_counts(seq: pa.Array) -> pa.Array:
    """Counts behind the quality and composition of coding sequences.

    Gaps are left out first. ``gc3`` and ``gc4`` (with their valid bases) are
    over the codons before a stop at the end.
    """
    data, rows = _text_buffer(seq.fill_null(""))
    slabs = [_cds_columns(part, local) for _, _, part, local in _parts(data, rows)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*slabs)], CDS_FIELDS)


def _cds_columns(data: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    data = _upper(data)
    kept = data != ord("-")
    rows = np.concatenate([[0], np.cumsum(kept)])[rows]
    data = data[kept]
    n_rows = len(rows) - 1
    many, row, number, at = _codons(data, rows)
    one, two, three = (_CODE[data[at + i]] for i in range(3))
    stop = (one == 3) & (((two == 0) & ((three == 0) | (three == 2))) | ((two == 2) & (three == 0)))
    last = number == many[row] - 1
    body = ~(last & stop)
    fourfold = body & (_FAMILY[one * 5 + two] < 255)

    def per_row(hits: np.ndarray) -> np.ndarray:
        return np.bincount(row[hits], minlength=n_rows).astype(np.int64)

    def whole(hits: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
        return total[rows[1:]] - total[rows[:-1]]

    gc, base = (three == 1) | (three == 2), three < 4
    columns = [
        np.diff(rows),
        per_row(stop & ~last),
        per_row(stop & last),
        *[whole(data == ord(c)) for c in "ACGTN"],
        whole(_AMBIGUOUS[data]),
        per_row(body & gc),
        per_row(body & base),
        per_row(fourfold & gc),
        per_row(fourfold & base),
    ]
    return [c.astype(np.int64) for c in columns]


WORD_FIELDS = ["word", "n_codons", "s1", "s2", "s3", "fourfold", "f0", "f1", "f2"]


WORD_TYPE = ArrayType(StructType([StructField(n, LongType()) for n in WORD_FIELDS]))


def codon_words(invalid: str):
    """Codon flags of an aligned sequence, 64 codons to a word.

    Per word: is each site valid, has the codon a four-fold prefix, and the
    three bits of the prefix family. Words of an alignment's sequences are
    combined by ``bit_and`` and ``bit_or``.
    """
    wrong = np.zeros(256, bool)
    wrong[[ord(c) for c in invalid]] = True

    @F.arrow_udf(WORD_TYPE)
    def words(seq: pa.Array) -> pa.Array:
        data, rows = _text_buffer(seq.fill_null(""))
        slabs = [slab(part, local) for _, _, part, local in _parts(data, rows)]
        offsets = np.concatenate([[0], np.cumsum((np.diff(rows) // 3 + 63) // 64)]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*slabs)], WORD_FIELDS)
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    def slab(data: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        data = _upper(data)
        many, row, number, at = _codons(data, rows)
        sites = [data[at + i] for i in range(3)]
        family = _FAMILY[_CODE[sites[0]] * 5 + _CODE[sites[1]]]
        flags = [~wrong[s] for s in sites] + [family < 255] + [(family >> b) & 1 == 1 for b in range(3)]
        begins = np.flatnonzero(number % 64 == 0)
        bit = (number % 64).astype(np.uint64)
        packed = [
            np.bitwise_or.reduceat(f.astype(np.uint64) << bit, begins).view(np.int64) if len(begins) else np.zeros(0, np.int64)
            for f in flags
        ]
        columns = [number[begins] // 64, np.minimum(64, many[row[begins]] - number[begins]), *packed]
        return [c.astype(np.int64) for c in columns]

    return words


THIRD_FIELDS = ["g_gc4", "c_gc4", "a_gc4", "t_gc4", "n_gc4"]
THIRD_TYPE = StructType([StructField(n, LongType()) for n in THIRD_FIELDS])


@F.arrow_udf(THIRD_TYPE)
def kept_thirds(seq: pa.Array, kept: pa.Array) -> pa.Array:
    """Bases at the third sites of the kept codons (words of 64 bits)."""
    data, rows = _text_buffer(seq.fill_null(""))
    starts = kept.offsets.to_numpy().astype(np.int64)
    words = kept.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    slabs = []
    for begin, end, part, local in _parts(data, rows):
        part = _upper(part)
        many, row, number, at = _codons(part, local)
        use = (words[starts[begin:end][row] + number // 64] >> (number % 64).astype(np.uint64)) & np.uint64(1) == 1
        third = part[at + 2]
        slabs.append([np.bincount(row[use & (third == ord(c))], minlength=len(many)).astype(np.int64) for c in "GCATN"])
    return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*slabs)], THIRD_FIELDS)


# Amino acids of the standard code, codons in T, C, A, G order.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_TCAG = np.full(256, 4, np.uint8)
for _i, _c in enumerate("TCAG"):
    _TCAG[[ord(_c), ord(_c.lower())]] = _i
# One byte per codon of T, C, A, G or something else: 125 of them, X where a base is something else.
_AMINO = np.full((5, 5, 5), ord("X"), np.uint8)
_AMINO[:4, :4, :4] = np.frombuffer(STANDARD_CODE.encode(), np.uint8).reshape(4, 4, 4)
_AMINO = _AMINO.ravel()


@F.arrow_udf(StringType())
def translate(seq: pa.Array) -> pa.Array:
    """Amino acids of the whole codons, one byte a base; NULL stays NULL."""
    data, rows = _text_buffer(seq.fill_null(""))
    many = np.diff(rows) // 3
    ends = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(ends[-1], np.uint8)
    for begin, end in _slabs(rows):
        n = many[begin:end]
        first = np.repeat(rows[begin:end] - 3 * (ends[begin:end] - ends[begin]), n) + 3 * np.arange(n.sum())
        codon = (_TCAG[data[first]].astype(np.int16) * 5 + _TCAG[data[first + 1]]) * 5 + _TCAG[data[first + 2]]
        out[ends[begin] : ends[end]] = _AMINO[codon]
    texts = pa.LargeStringArray.from_buffers(len(seq), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    return pa.compute.if_else(seq.is_valid(), texts, None)


@F.arrow_udf(LongType())
def mismatches(a: pa.Array, b: pa.Array) -> pa.Array:
    """Places at which two texts of equal length differ, one byte a base; NULL for a NULL or unequal lengths."""
    (x, rows_x), (y, rows_y) = _text_buffer(a.fill_null("")), _text_buffer(b.fill_null(""))
    size = np.diff(rows_x)
    known = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False) & (size == np.diff(rows_y))
    out = np.zeros(len(a), np.int64)
    size = np.where(known, size, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    for begin, end in _slabs(ends):
        n = size[begin:end]
        place = np.arange(n.sum()) - np.repeat(ends[begin:end] - ends[begin], n)
        differ = x[np.repeat(rows_x[begin:end], n) + place] != y[np.repeat(rows_y[begin:end], n) + place]
        total = np.concatenate([[0], np.cumsum(differ)])
        local = ends[begin : end + 1] - ends[begin]
        out[begin:end] = total[local[1:]] - total[local[:-1]]
    return pa.array(out, mask=~known)
