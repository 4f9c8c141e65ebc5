"""Ranked lexical search over K2-treaps of the term-document grid.

The index is a table of shards. A shard is a range of consecutive documents of one input partition; its grid has a row per
term (most frequent first) and a column per document, and holds the impact of the term in the document. The grid is
cut into squares as wide as the shard; each square is a K2-tree: per inner cell four bits say which quarters hold
something, in breadth-first order, so children are found by counting bits. Every cell also keeps the largest impact inside
it, stored as the difference to its parent's. Bits and differences are compressed.

A search descends the row paths of an item's terms jointly. A range of documents is bounded by the sum of weight times cell
maximum over the terms; the ranges with the largest bounds are halved first, several per item and round, and a range
is dropped when its bound is below the item's k-th best score. Halving a range moves each term to the quarter of
its row. A range of one document has its exact score. Best scores carry over from shard to shard within a task; tasks return
k rows per item, and these are ranked.

Terms are maximal runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. The score of a document is the
sum over the item's terms of weight times impact, all integers: see ``weight`` and ``impacts``.

Defined cases: null and empty texts, and texts without a term, hold no term, count in no statistic and are never found; an item
without terms has no rows. Rows that repeat are documents of their own. Items of one id are one item with the terms of
all. Equal scores are ordered by document id, nulls last. Empty tables give an empty result. Only ids and texts are
read, so other columns do not matter. A very long text is one column; memory is bounded by its distinct terms.
Items are searched in blocks of about ``BLOCK_TERMS`` terms, each against the whole index.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baseloom.llm.registry import query, staged, table

POSTINGS = 1 << 20
MOST_DOCS = 1 << 13
AT_ONCE = 512
FRONTIER = 1 << 21
BLOCK_TERMS = 200_000
_SHARD = "n_docs int, levels int, docs binary, terms binary, frequencies binary, cells binary, maxima binary"


def _plain() -> bytes:
    """Bytes outside terms become spaces, A-Z become a-z; bytes of other characters stay."""
    out = bytearray(b" " * 128) + bytearray(range(128, 256))
    for b in b"0123456789abcdefghijklmnopqrstuvwxyz":
        out[b] = b
    for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[b] = b + 32
    return bytes(out)


_TABLE = _plain()


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def damping(length: int, n: int, total: int) -> int:
    return 100 - 90 + (90 * length * n) // total


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def corpus_size(documents: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def run(batches):
        n = total = 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    inside = np.frombuffer(text.translate(_TABLE), "u1") != 32
                    count = int(inside[0]) + np.count_nonzero(inside[1:] > inside[:-1])
                    n, total = n + (count > 0), total + count
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    row = documents.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


class _Vocabulary(dict):
    """Numbers terms in the order in which they are met."""

    def __missing__(self, term):
        self[term] = number = len(self)
        return number


def _interleaved(rows: np.ndarray, columns: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(rows), "i8")
    for b in range(bits):
        out |= ((rows >> b) & 1) << (2 * b + 1) | ((columns >> b) & 1) << (2 * b)
    return out


def build_cells(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The four child bits of each inner cell, and the maximum of each cell, both breadth first. Squares have 2**bits rows."""
    order = np.argsort(key := (rows >> bits) << (2 * bits) | _interleaved(rows & ((1 << bits) - 1), columns, bits))
    keys, best = key[order], values[order]
    nibbles, maxima = [], [best]
    for _ in range(bits):
        up = keys >> 2
        first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]]) if len(up) else np.zeros(0, "i8")
        nibbles.append(np.bitwise_or.reduceat(1 << (keys & 3), first).astype("u1"))
        best = np.maximum.reduceat(best, first)
        maxima.append(best)
        keys = up[first]
    return np.concatenate(nibbles[::-1] or [np.zeros(0, "u1")]), np.concatenate(maxima[::-1])


_ONES = np.array([bin(i).count("1") for i in range(16)], "u1")


class Grid:
    """The cells of one shard, ready to descend."""

    def __init__(self, nibbles: np.ndarray, maxima: np.ndarray, bits: int):
        self.bits, self.nibbles, self.maxima = bits, nibbles, maxima
        counts = np.cumsum(_ONES[nibbles], dtype="i8")
        roots = len(maxima) - int(counts[-1]) if len(counts) else len(maxima)
        self.children = (np.r_[roots, roots + counts[:-1]] if len(counts) else counts).astype("i4")

    def pack(self) -> tuple[bytes, bytes]:
        """Bits two cells to a byte, maxima as differences to the parent's."""
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        even = np.r_[self.nibbles, np.zeros(len(self.nibbles) % 2, "u1")]
        below = self.maxima.copy()
        parents = np.repeat(np.arange(len(self.nibbles)), _ONES[self.nibbles])
        below[len(below) - len(parents) :] = self.maxima[parents] - below[len(below) - len(parents) :]
        return press((even[::2] | even[1::2] << 4).tobytes()), press(below.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())

    @classmethod
    def unpack(cls, cells: bytes, maxima: bytes, bits: int) -> "Grid":
        import zstandard

        free = zstandard.ZstdDecompressor().decompress
        packed = np.frombuffer(free(cells), "u1")
        below = np.ascontiguousarray(np.frombuffer(free(maxima), "u1").reshape(4, -1).T).view("<u4").ravel().astype("i8")
        nibbles = np.stack([packed & 15, packed >> 4], 1).ravel()
        if len(nibbles) and not nibbles[-1]:
            nibbles = nibbles[:-1]
        inner = _ONES[nibbles]
        roots = len(below) - int(inner.sum())
        # Parents come before children: level by level, a level's cells add up from the one above.
        at, end, parent = 0, roots, 0
        while end < len(below):
            size = int(inner[parent : parent + end - at].sum())
            above = np.repeat(np.arange(at, end), inner[parent : parent + end - at])
            below[end : end + size] = below[above] - below[end : end + size]
            parent, at, end = parent + end - at, end, end + size
        return cls(nibbles, below, bits)


def _best(item, score, order, k):
    """Positions of the k best of each item, by score and then order, and the rank of each."""
    by = np.lexsort((order, -score, item))
    first = np.flatnonzero(np.r_[True, item[by][1:] != item[by][:-1]]) if len(by) else np.zeros(0, "i8")
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
    return by[rank < k]


def descend(grid: Grid, item: np.ndarray, row: np.ndarray, w: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Item, column and score of documents that include the k best of each item; ``floor`` holds scores that count, by item.

    ``item``, ``row`` and ``w`` list the terms of items that occur in the shard, in the order of items.
    """
    floor, bits = floor.copy(), grid.bits
    none = np.zeros(0, "i8")
    best = (none, none, none)
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else none
    node = row >> bits
    # Ranges: item, level, first column in units of its width, bound.
    r_item, r_level, r_column = item[starts], np.zeros(len(starts), "i8"), np.zeros(len(starts), "i8")
    r_bound = np.add.reduceat(w * grid.maxima[node], starts) if len(starts) else none
    # Terms of ranges: the range, the cell, the number of the term.
    t_range, t_node = np.repeat(np.arange(len(starts), dtype="i4"), np.diff(np.r_[starts, len(item)])), node.astype("i4")
    t_term, line = np.arange(len(item), dtype="i4"), row & ((1 << bits) - 1)
    while len(r_item):
        done = r_level == bits
        if done.any():
            found = tuple(np.concatenate([a, b]) for a, b in zip(best, (r_item[done], r_column[done], r_bound[done])))
            keep = _best(found[0], found[2], found[1], k)
            best = tuple(a[keep] for a in found)
            full = np.bincount(best[0], minlength=len(floor)) >= k
            last = np.full(len(floor), np.iinfo("i8").max)
            np.minimum.at(last, best[0], best[2])
            floor = np.where(full, np.maximum(floor, last), floor)
        live = ~done & (r_bound >= floor[r_item])
        chosen = np.zeros(len(r_item), bool)
        alive = np.flatnonzero(live)
        chosen[alive[_best(r_item[alive], r_bound[alive], alive, AT_ONCE)]] = True
        wait = live & ~chosen
        stay = np.flatnonzero(wait[t_range])
        number = np.cumsum(wait, dtype="i4") - 1
        parts = [(r_item[wait], r_level[wait], r_column[wait], r_bound[wait], number[t_range[stay]], t_node[stay], t_term[stay])]
        go = np.flatnonzero(chosen[t_range])
        over, cell, term = t_range[go], t_node[go], t_term[go]
        side = (line[term] >> (bits - 1 - r_level[over])) & 1 if len(go) else go
        nibble, child = (grid.nibbles[cell], grid.children[cell]) if len(go) else (go, go)
        for half in (0, 1):
            quarter = 2 * side + half
            has = np.flatnonzero((nibble >> quarter) & 1)
            if not len(has):
                continue
            to = child[has] + _ONES[nibble[has] & ((1 << quarter[has]) - 1)]
            of, which = over[has], term[has]
            begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            bound = np.add.reduceat(w[which] * grid.maxima[to], begin)
            who = of[begin]
            worth = bound >= floor[r_item[who]]
            place = np.cumsum(worth, dtype="i4") - 1
            each = np.repeat(np.arange(len(begin), dtype="i4"), np.diff(np.r_[begin, len(of)]))
            stay = np.flatnonzero(worth[each])
            who = who[worth]
            parts.append((r_item[who], r_level[who] + 1, 2 * r_column[who] + half, bound[worth], place[each[stay]], to[stay], which[stay]))
        shift = np.cumsum([0] + [len(p[0]) for p in parts])
        r_item, r_level, r_column, r_bound, t_node, t_term = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 5, 6))
        t_range = np.concatenate([p[4] + np.int32(s) for p, s in zip(parts, shift)])
    return best


def build_index(documents: DataFrame, postings: int = POSTINGS) -> tuple[DataFrame, int, int]:
    """The shards, written to the shared folder, with the number of documents that hold a term and of all terms."""
    n, total = corpus_size(documents)

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        vocabulary, ids, sizes, words, held = _Vocabulary(), [], [], [], 0

        def shard():
            column = np.repeat(np.arange(len(ids)), [len(u) for u, _ in words])
            number = np.concatenate([u for u, _ in words]).astype("i8")
            tf = np.concatenate([c for _, c in words]).astype("i8")
            df = np.bincount(number, minlength=len(vocabulary))
            ranked = np.argsort(-df, kind="stable")
            row = np.empty(len(ranked), "i8")
            row[ranked] = np.arange(len(ranked))
            m = np.array([damping(s, n, total) for s in sizes], "i8")
            bits = max(1, (len(ids) - 1).bit_length())
            cells, maxima = Grid(*build_cells(row[number], column, impacts(tf, m[column]), bits), bits).pack()
            names = list(vocabulary)
            known = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes()
            values = [len(ids), bits, known, press(b" ".join([names[i] for i in ranked.tolist()])), press(df[ranked].astype("<u4").tobytes()), cells, maxima]
            types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in _SHARD.split(", ")])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for key, text in zip(batch.column(0).to_pylist(), texts):
                found = terms_of(text.as_py())
                if not found:
                    continue
                counts = Counter(found)
                words.append(tuple(np.fromiter(v, "i4", len(counts)) for v in (map(vocabulary.__getitem__, counts), counts.values())))
                ids.append(key), sizes.append(len(found))
                held += len(counts)
                if held >= postings or len(ids) >= MOST_DOCS:
                    yield shard()
                    vocabulary, ids, sizes, words, held = _Vocabulary(), [], [], [], 0
        if ids:
            yield shard()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SHARD)
    return staged(rows, "treap"), n, total


def _item_terms(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1).cast(pa.binary())]
            which = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array([t for f in found for t in f], pa.binary())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term binary").distinct()


def _frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    def run(batches):
        import zstandard

        free = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1)):
                counts = np.frombuffer(free(counts.as_py()), "<u4")
                at = [(w, i) for i, w in enumerate(free(words.as_py()).split(b" ")) if w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in at], pa.binary()), pa.array(counts[[i for _, i in at]].astype("i8"), pa.int64())], names=["term", "df"])

    found = index.select("terms", "frequencies").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in found.collect()}


def _search_block(index: DataFrame, pairs: list[tuple[int | None, bytes]], n: int, k: int) -> DataFrame:
    """The best of each task for a bounded list of (item, term)."""
    df = _frequencies(index, {t for _, t in pairs})
    ids = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i or 0))
    number = {i: x for x, i in enumerate(ids)}
    known = sorted((number[i], t, weight(n, df[t])) for i, t in pairs if t in df)
    items, terms, weights = (list(c) for c in zip(*known)) if known else ([], [], [])

    def run(batches):
        import zstandard

        free = zstandard.ZstdDecompressor().decompress
        none = np.zeros(0, "i8")
        best = (none, none, none, none)
        floor = np.ones(len(ids), "i8")
        of, w = np.array(items, "i8"), np.array(weights, "i8")
        for batch in batches:
            for at in range(batch.num_rows):
                size, bits, docs, words, cells, maxima = (batch.column(c)[at].as_py() for c in range(6))
                keys, missing = np.frombuffer(docs[: 8 * size], "<i8"), np.frombuffer(docs[8 * size :], "u1").astype("i8")
                rows = {t: i for i, t in enumerate(free(words).split(b" "))}
                row = np.array([rows.get(t, -1) for t in terms], "i8")
                here = np.flatnonzero(row >= 0)
                grid = Grid.unpack(cells, maxima, bits)
                # Items are taken together as long as their ranges stay within bounds.
                group = np.cumsum(np.ones(len(here), "i8") * size) // FRONTIER
                group = np.maximum.reduceat(group, (s := np.flatnonzero(np.r_[True, of[here][1:] != of[here][:-1]])))[np.cumsum(np.r_[True, of[here][1:] != of[here][:-1]]) - 1] if len(here) else here
                for g in np.unique(group):
                    some = here[group == g]
                    who, column, score = descend(grid, of[some], row[some], w[some], floor, k)
                    found = tuple(np.concatenate(p) for p in zip(best, (who, score, keys[column], missing[column])))
                    by = np.lexsort((found[2], found[3], -found[1], found[0]))
                    found = tuple(a[by] for a in found)
                    first = np.flatnonzero(np.r_[True, found[0][1:] != found[0][:-1]]) if len(by) else none
                    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
                    best = tuple(a[rank < k] for a in found)
                    floor[found[0][rank == k - 1]] = found[1][rank == k - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in best[0]], pa.int64()), pa.array([None if gone else key for key, gone in zip(best[2].tolist(), best[3])], pa.int64()), pa.array(best[1], pa.int64())],
            names=["item_id", "doc_id", "score"],
        )

    return index.select("n_docs", "levels", "docs", "terms", "cells", "maxima").mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: DataFrame, n: int, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of largest score above 0 of each item."""
    pairs = staged(_item_terms(items), "items")
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    found = None
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else pairs
        rows = _search_block(index, [(r.item_id, bytes(r.term)) for r in mine.collect()], n, k)
        rows = staged(rows, "found") if blocks > 1 else rows
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op11_lexical_search",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS t FROM documents),
    h AS (SELECT * FROM d WHERE len(t) > 0),
    c AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM h),
    tf AS (SELECT r, doc_id, len(t) AS size, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM h) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, n),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
    s AS (
      SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n) // l))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term), c GROUP BY ALL),
    k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
    """,
)
def op11_lexical_search(spark, d):
    index, n, _ = build_index(table(spark, d, "documents"))
    return search(index, n, table(spark, d, "benchmark"))
