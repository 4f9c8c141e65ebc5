"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are identical) and at least max(24, 3 q) words that no
neighbouring word extends with that period.

The dictionary names the factors whose length is a power of two: equal factors of one document have equal names, and the name
of a factor comes from the names of its halves. Factors that occur once get a name of their own and are not
sorted again. In every level, a factor and its next occurrence at a distance of at most the factor's length give a
period. Neighbouring places with the same distance propose one run together; they are the union of the arithmetic
progressions of one period. The dictionary extends a proposal to both sides, from long to short factors. A run is proposed
by several levels; duplicates go.

Why nothing is missed: let a run have period q. With factor length P = 16 for q up to 16, else the power of two with P/2 < q <= P,
the run holds its first factor of length P again q words later (q + P words are at most the run's least length), and
not earlier, as q is the smallest period and P >= q. Why no period is too large: with a smaller period the
factor would occur earlier, inside the extended stretch.

The work is done in Arrow batches, several documents at a time, without a shuffle. Memory is about 4 bytes per word and
level for one batch of ``BATCH_BYTES`` of text, or for one document, if that is longer.

Defined cases: null and empty texts have no words and no run. Repeated rows give repeated rows. A null id counts as the text
"None" where ids choose the folded copy. Very long texts are worked on whole. An empty table gives an empty result; only id and
text are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from baseloom.llm.registry import query, table

LEAST, TIMES = 24, 3
FIRST_LEVEL = 4
BATCH_BYTES = 2_000_000


def name_factors(codes: np.ndarray) -> list[np.ndarray]:
    """Names of the factors of 1, 2, 4, ... words at each place; names from len(codes) on occur once. Ends where all do."""
    n = len(codes)
    own = np.arange(n, 2 * n)
    repeated = np.bincount(codes, minlength=1)[codes] > 1 if n else np.zeros(0, bool)
    levels = [np.where(repeated, codes, own)]
    width = 1
    while True:
        names = levels[-1]
        left = np.flatnonzero(names[: max(0, n - width)] < n)
        left = left[names[left + width] < n]
        key = names[left] * n + names[left + width]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        many = (np.bincount(group) > 1)[group] if len(key) else new
        if not many.any():
            return levels
        out = own.copy()
        out[left[order[many]]] = group[many]
        levels.append(out)
        width *= 2


def proposals(names: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and period of each progression of occurrences at distances from ``least`` to ``width``."""
    at = np.flatnonzero(names < len(names))
    order = at[np.argsort(names[at], kind="stable")]
    gap = order[1:] - order[:-1]
    close = (names[order[1:]] == names[order[:-1]]) & (gap >= least) & (gap <= width)
    place, period = order[:-1][close], gap[close]
    by = np.lexsort((place, period))
    place, period = place[by], period[by]
    first = np.r_[True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)] if len(by) else close[:0]
    return place[first], period[first]


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from places a and b on, to the right (step 1) or to the left (step -1)."""
    n, out = len(levels[0]), np.zeros(len(a), "i8")

    def agree(level, width):
        x, y = a + step * out, b + step * out
        if step < 0:
            x, y = x - width + 1, y - width + 1
        ok = (x >= 0) & (y >= 0) & (x < n) & (y < n)
        return ok & (level[np.where(ok, x, 0)] == level[np.where(ok, y, 0)])

    for k in range(len(levels) - 1, -1, -1):
        # Longer equal factors than the last level's do not occur, so one step per level is enough.
        out += np.where(agree(levels[k], 1 << k), 1 << k, 0)
    return out


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a sequence, by start, then period. Documents may follow each other if they share no code."""
    levels = name_factors(codes)
    found = [np.zeros((0, 3), "i8")]
    for k in range(FIRST_LEVEL, len(levels)):
        place, period = proposals(levels[k], 1 << k, 1 if k == FIRST_LEVEL else (1 << (k - 1)) + 1)
        if len(place):
            begin = place - _common(levels, place - 1, place - 1 + period, -1)
            length = place + period + _common(levels, place, place + period, 1) - begin
            ok = length >= np.maximum(LEAST, TIMES * period)
            found.append(np.stack([begin, period, length], 1)[ok])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def folded(words: list, key: str) -> list:
    """One document in ten, chosen by its id, gets a periodic end, so that runs of all periods occur."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def document_runs(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each document, with starts in its own words."""
    codes, base = [], 0
    for words in texts:
        number = dict(zip(dict.fromkeys(words), range(base, base + len(words))))
        codes.append(np.fromiter(map(number.__getitem__, words), "i8", len(words)))
        base += len(number)
    ends = np.cumsum([len(c) for c in codes])
    start, length, period = runs(np.concatenate(codes)) if codes else (np.zeros(0, "i8"),) * 3
    cut = np.searchsorted(start, np.r_[0, ends])
    return [(start[i:j] - (e - len(c)), length[i:j], period[i:j]) for i, j, e, c in zip(cut[:-1], cut[1:], ends, codes)]


def _strongest(start, length, period):
    """The run with the most repetitions; ties by start, then period."""
    best = None
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


_SCHEMA = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(documents: DataFrame, fold: bool = False, collapsed: bool = False) -> DataFrame:
    """Per document its runs (digest and strongest) and the digest of the text without the repetitions after a run's first period.

    ``fold`` makes one document in ten periodic first; ``collapsed`` adds ``runs`` and the remaining ``text``.
    """
    schema = _SCHEMA.format(documents.schema["doc_id"].dataType.simpleString())
    schema += ", runs array<struct<start:long,length:long,period:long>>, text string" if collapsed else ""
    names = [c.split()[0] for c in _SCHEMA.split(", ")] + (["runs", "text"] if collapsed else [])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def described(keys, texts):
        rows = []
        for words, (start, length, period) in zip(texts, document_runs(texts)):
            listed = list(zip(start.tolist(), length.tolist(), period.tolist()))
            if listed:
                edge = np.zeros(len(words) + 1, "i8")
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            left = b" ".join(words)
            digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest()
            best = _strongest(start, length, period)
            best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            rows.append((len(listed), *best, digest, hashlib.sha256(left).hexdigest(), listed, left.decode()))
        columns = list(zip(*rows))
        arrays = [keys, *(pa.array(c, t) for c, t in zip(columns, kinds))]
        if collapsed:
            arrays += [pa.array([[dict(zip(("start", "length", "period"), r)) for r in c] for c in columns[7]], run_type), pa.array(columns[8], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.binary())
            at, held, words = 0, 0, []
            for i, (key, text) in enumerate(zip(keys, texts)):
                text = text.as_py() or b""
                split = text.split()  # bytes are split at ASCII white space only
                words.append(folded(split, str(key.as_py())) if fold else split)
                held += len(text)
                if held >= BATCH_BYTES:
                    yield described(keys.slice(at, i + 1 - at), words)
                    at, held, words = i + 1, 0, []
            if words:
                yield described(keys.slice(at), words)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, d):
    return find_runs(table(spark, d, "documents"), fold=True)
