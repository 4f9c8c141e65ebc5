"""Fuzzy line dedup by MinHash: one line per component of similar lines stays, the first by document and place.

Equal lines are one class, by a 64-bit hash. Each class has a MinHash signature over its character shingles (12 characters, so
that lines of a small vocabulary are not alike by chance); seven bands of three values are its keys. Classes that share a band
are candidates: first each with one hub of the band, then, in bands that still hold several components, all pairs of different
components whose longer sketches agree enough. Candidates are verified by the exact Jaccard similarity of
their shingle sets, at least 75 percent; links are closed to components by distributed union-find. A pair at 75 percent shares a band with
probability 0.978, at 80 percent with 0.993.

A hot line is one class before rows move; bands with many members are dealt to pairs of leaves.

Defined cases: lines end at line feeds; spaces, tabs and returns at their ends do not count. Lines without a word are never
compared and stay. A line shorter than a shingle is its own single shingle. A null text has no lines and stays null. Null ids come first. Rows that
repeat both id and text are one document and cut alike; rows of one id with other texts are documents of their own, in the order of their
texts' hashes where places tie. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baseloom.llm.components import column, components
from baseloom.llm.jaccard_join import LEAF, _shared, leaf_tasks, small_pairs
from baseloom.llm.registry import fresh, query, staged, table

SHINGLE = 12
BANDS, ROWS = 7, 3
# A longer signature of the classes that share a band, and the least share of its values that links agree in: at 75 percent
# similarity, 0.998 of all pairs reach it.
SKETCH, AGREE = 96, 0.62
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.RandomState(20240229)
_TIMES = (_random.randint(1, 2**31, SKETCH).astype("u4") << np.uint32(1)) | np.uint32(1)
_XOR = _random.randint(0, 2**31, SKETCH).astype("u4")
_EDGES = " \t\r\x0b\x0c"


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all character shingles of the lines, one after the other, and where each line starts."""
    sizes = np.array([len(s) for s in lines], "i8")
    text = "\n".join(lines) + "\n" * SHINGLE
    with np.errstate(over="ignore"):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8") + np.uint64(1)

        def join(a, b, n):
            size = min(len(a), len(b) - n)
            power = np.uint64(pow(int(_PRIME), n, 2**64))
            return a[:size] * power + b[n : n + size]

        two = join(c, c, 1)
        four = join(two, two, 2)
        eight = join(four, four, 4)
        h = join(eight, four, 8)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    ends = np.cumsum(counts)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
    out = h[places]
    for i in np.flatnonzero(sizes < SHINGLE):
        # The window of a short line would run into the next.
        value = np.uint64(0xA5A5A5A5A5A5A5A5)
        with np.errstate(over="ignore"):
            for ch in lines[i]:
                value = (value ^ np.uint64(ord(ch))) * np.uint64(0xBF58476D1CE4E5B9)
                value ^= value >> np.uint64(31)
        out[ends[i] - counts[i]] = value
    return out, ends - counts


def signatures(lines: list[str], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of MinHash values per line."""
    out = np.zeros((len(lines), size), "u4")
    at = 0
    while at < len(lines):
        end, held = at, 0
        while end < len(lines) and (held < 100_000 or end == at):
            held += len(lines[end])
            end += 1
        h, starts = _hashes(lines[at:end])
        x = (h & np.uint64(0xFFFFFFFF)).astype("u4")
        t = np.empty_like(x)
        for k in range(size):
            np.bitwise_xor(x, _XOR[k], out=t)
            np.multiply(t, _TIMES[k], out=t)
            out[at:end, k] = np.minimum.reduceat(t, starts)
        at = end
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    """64-bit keys, one per band and line."""
    key = np.zeros((len(signature), BANDS), "u8")
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = (key ^ signature[:, r : BANDS * ROWS : ROWS].astype("u8")) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(32)
        key = (key + np.arange(BANDS, dtype="u8")) * np.uint64(0x9FB21C651E98DF25)
        key ^= key >> np.uint64(29)
    return key.view("i8")


def exact(a: str, b: str) -> tuple[int, int]:
    """Sizes of the intersection and the union of two lines' shingle sets."""
    p, q = np.unique(_hashes([a])[0]), np.unique(_hashes([b])[0])
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both, len(p) + len(q) - both


def distinct(lines: list[str]) -> list[int]:
    """Number of distinct shingles per line, as ``exact`` counts them."""
    out, at = [], 0
    while at < len(lines):
        end, held = at, 0
        while end < len(lines) and (held < 100_000 or end == at):
            held += len(lines[end])
            end += 1
        h, starts = _hashes(lines[at:end])
        line = np.repeat(np.arange(end - at), np.diff(np.r_[starts, len(h)]))
        order = np.lexsort((h, line))
        new = np.r_[True, (np.diff(line) > 0) | (h[order][1:] != h[order][:-1])]
        out.extend(np.bincount(line[new], minlength=end - at).tolist())
        at = end
    return out


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, t, place, line, f): lines with a word, t the hash of their text, f their class."""
    # The hash is made before the lines, else it is made, and the text copied, for each of them.
    lines = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("t"))
    lines = lines.select("doc_id", "t", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    # Trimming looks at every character, so only lines with something to trim go there.
    line = F.col("line")
    edged = reduce(or_, [end(F.lit(c)) for c in _EDGES for end in (line.startswith, line.endswith)])
    lines = lines.withColumn("line", F.when(edged, F.trim(line, F.lit(_EDGES))).otherwise(line)).where(F.col("line") != "")
    return lines.withColumn("f", F.xxhash64("line"))


def _placed(batches):
    """Rows (doc_id, t, place, f, size, head, keys) for rows (doc_id, t, place, f, line): the line's length, whether it is its document row's
    first, and its bands. A class has bands once per task.
    """
    seen: set[int] = set()
    last = None
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            t, place, f = (column(part, c) for c in (1, 2, 3))
            # The lines of one row lie one after the other by place, also where equal rows follow each other.
            head = np.r_[last is None or last[0] != t[0] or last[1] >= place[0], (t[1:] != t[:-1]) | (place[1:] <= place[:-1])]
            last = t[-1], place[-1]
            new = np.zeros(len(f), bool)
            for i, value in enumerate(f.tolist()):
                if value not in seen:
                    seen.add(value)
                    new[i] = True
            lines = part.column(4).filter(pa.array(new, pa.bool_())).to_pylist()
            keys = _bands(signatures(lines)).reshape(-1)
            keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(new * BANDS)], pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:4], pc.cast(pc.utf8_length(part.column(4)), pa.int32()), pa.array(head, pa.bool_()), keys],
                names=["doc_id", "t", "place", "f", "size", "head", "keys"],
            )


def placed(lines: DataFrame) -> DataFrame:
    """(doc_id, t, place, f, size, head, keys), written: see ``_placed``."""
    rows = lines.select("doc_id", "t", "place", "f", "line")
    made = [T.StructField("size", T.IntegerType()), T.StructField("head", T.BooleanType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return staged(rows.mapInArrow(_placed, T.StructType([*rows.schema.fields[:4], *made])), "places")


def _described(batches):
    """The involved classes with number of distinct shingles, sketch and bands."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            lines = part.column(1).to_pylist()
            s = signatures(lines, SKETCH)
            keys = _bands(s)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(distinct(lines), pa.int64()),
                 pa.array([r.tobytes() for r in s], pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary())],
                names=["f", "line", "n", "sketch", "bands"],
            )


def alike(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair of lines whether their shingle sets have a Jaccard similarity of 75 percent or more, as ``exact`` counts."""
    out, at = np.zeros(len(left), bool), 0
    while at < len(left):
        end, held = at, 0
        while end < len(left) and (held < 200_000 or end == at):
            held += len(left[end]) + len(right[end])
            end += 1
        n = end - at
        h, starts = _hashes(left[at:end] + right[at:end])
        line = np.repeat(np.arange(2 * n), np.diff(np.r_[starts, len(h)]))
        order = np.lexsort((line, h, line % n))
        h, line = h[order], line[order]
        pair = line % n
        same = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
        new = np.r_[True, ~same | (line[1:] != line[:-1])]
        # A shingle of both sides is there twice in a row once repeats on one side are gone.
        h, line, pair = h[new], line[new], pair[new]
        both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])], minlength=n)
        sizes = np.bincount(pair, minlength=n)
        out[at:end] = 100 * both >= 75 * (sizes - both)
        at = end
    return out


def _checked(batches):
    for batch in batches:
        good = alike(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of each line."""
    out, at = [], 0
    while at < len(lines):
        end, held = at, 0
        while end < len(lines) and (held < 100_000 or end == at):
            held += len(lines[end])
            end += 1
        h, starts = _hashes(lines[at:end])
        out.extend(np.unique(x) for x in np.split(h, starts[1:]))
        at = end
    return out


def _paired(batches):
    """Rows (key, l, r, side, f, component, sketch, bands, line) in the order of key, l, r, side, f: links of components by verified pairs.

    A pair is looked at by its first common band, if the sketches agree in ``AGREE`` of their values or more; then the shingle sets are compared.
    Small groups are compared many at once. Pairs that links found in the same block of rows join already are passed over.
    """

    def near(s, bands, key, i, j):
        good = np.zeros(len(i), bool)
        for at in range(0, len(i), 8192):
            p, q = i[at : at + 8192], j[at : at + 8192]
            some = np.flatnonzero((s[p] == s[q]).sum(axis=1) >= AGREE * s.shape[1])
            p = p[some]
            first = np.argmax(bands[p] == bands[q[some]], axis=1)
            good[at + some[bands[p, first] == key[p]]] = True
        return i[good], j[good]

    def found(held):
        key, l, r, side, f, part = (column(held, c) for c in range(6))
        s = np.frombuffer(b"".join(held.column(6).to_pylist()), "<u4").reshape(len(key), -1)
        bands = np.frombuffer(b"".join(held.column(7).to_pylist()), "<i8").reshape(len(key), -1)
        task = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (l[1:] != l[:-1]) | (r[1:] != r[:-1])])
        i, j, long = small_pairs(task)
        fit = (part[i] != part[j]) & ((l[i] == r[i]) | (side[i] != side[j]))
        pairs = [near(s, bands, key, i[fit], j[fit])]
        for t in np.unique(task[long]):
            lo, hi = np.searchsorted(task, [t, t + 1])
            rows = np.arange(lo, hi)
            left = rows[side[lo:hi] == 0]
            right = left if l[lo] == r[lo] else rows[side[lo:hi] == 1]
            for x in left:
                other = right[(part[right] != part[x]) & ((right > x) | (l[lo] != r[lo]))]
                pairs.append(near(s, bands, key, np.full(len(other), x), other))
        i, j = (np.concatenate(x) for x in zip(*pairs))
        # A class is in several groups; its set is cut once.
        wanted = np.unique(np.r_[i, j])
        _, first = np.unique(f[wanted], return_index=True)
        wanted = wanted[first]
        sets = dict(zip(f[wanted].tolist(), _sets(held.column(8).take(pa.array(wanted, pa.int64())).to_pylist())))
        up: dict[int, int] = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        out = []
        for x, y, a, b in zip(f[i].tolist(), f[j].tolist(), part[i].tolist(), part[j].tolist()):
            a, b = sorted((root(a), root(b)))
            if a != b:
                p, q = sets[x], sets[y]
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= 75 * (len(p) + len(q) - both):
                    up[b] = a
                    out.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        if held.num_rows < LEAF:
            continue
        key, l, r = (column(held, c) for c in range(3))
        # The last group may go on in the next batch.
        edge = int(np.flatnonzero((key == key[-1]) & (l == l[-1]) & (r == r[-1]))[0])
        if edge:
            yield found(held.slice(0, edge))
            held = held.slice(edge)
    if held is not None and held.num_rows:
        yield found(held)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = pairs.join(texts.select(F.col("f").alias("a"), F.col("line").alias("x")), "a")
    both = left.join(texts.select(F.col("f").alias("b"), F.col("line").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_checked, "a long, b long")


def line_components(lines: DataFrame, places: DataFrame) -> DataFrame:
    """(f, component) of all classes that share a band with another; ``places`` are the ``lines`` as ``placed`` writes them."""
    signed = places.select(F.explode("keys").alias("key"), "f")
    shared = staged(signed.repartition("key").sortWithinPartitions("key", "f").mapInArrow(_shared, "key long, f long, df long"), "bands")
    involved = shared.select("f").distinct()
    texts = lines.select("f", "line").join(involved, "f", "left_semi").dropDuplicates(["f"])
    texts = staged(texts.mapInArrow(_described, "f long, line string, n long, sketch binary, bands binary"), "lines")
    # The hub of a band is the member that most others meet; in a family of edited copies that is the text they stem from.
    met = shared.groupBy("f").agg(F.sum("df").alias("met"))
    ranked = shared.join(met, "f").select("key", "f", "met")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("met", "f"))["f"].alias("hub"))
    star = ranked.join(hubs, "key").where("f != hub").select(F.least("hub", "f").alias("a"), F.greatest("hub", "f").alias("b")).distinct()
    first = staged(_verified(star, texts), "line-star")
    known = texts.join(components(first).withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    known = staged(known, "line-known")
    tasks = leaf_tasks(shared.select("key", "f").join(known.select("f", "n", "component"), "f"))
    tasks = tasks.join(known, "f").select("key", "l", "r", "side", "f", "component", "sketch", "bands", "line")
    second = tasks.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r", "side", "f").mapInArrow(_paired, "a long, b long")
    # The links of the second pass are links of components of the first.
    joined = components(second).select(F.col("node").alias("component"), F.col("component").alias("_all"))
    return known.select("f", "component").join(joined, "component", "left").select("f", F.coalesce("_all", "component").alias("component"))


def removed_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, t, n_lines, n_chars, removed): per document its lines with a word, the characters of those that stay, and the places of those that go."""
    lines = lines_of(documents)
    places = placed(lines)
    # A row that is there n times has each of its places n times, and n of them are heads.
    per = places.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("chars"), F.count_if("head").alias("copies"))
    # Only lines of classes that come twice or have a link can go.
    classes = places.groupBy("f").agg(F.count(F.lit(1)).alias("rows")).join(line_components(lines, places), "f", "left")
    classes = classes.where("rows > 1 or component is not null").select("f", F.coalesce("component", "f").alias("component"))
    rows = places.join(classes, "f").select("component", F.struct("doc_id", "place", "t").alias("row"), "size")
    first = rows.groupBy("component").agg(F.min("row").alias("first"))
    gone = rows.join(first, "component").where(~F.col("row").eqNullSafe(F.col("first"))).select("row.*", "size")
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.sum("size").alias("less"), F.array_sort(F.collect_set("place")).alias("removed"))
    found = per.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    return found.select(
        "doc_id",
        "t",
        F.expr("rows DIV copies").alias("n_lines"),
        F.expr("(chars - coalesce(less, 0L)) DIV copies").alias("n_chars"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def _left(text: Column, removed: Column) -> Column:
    lines = F.split(text, "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.when(removed.isNull() | (F.size(removed) == 0), text).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents with the text that is left, ``n_lines`` and ``n_removed``."""
    i, t, r, n = (fresh(x) for x in ("id", "hash", "removed", "lines"))
    found = removed_lines(documents).select(F.col("doc_id").alias(i), F.col("t").alias(t), F.col("removed").alias(r), F.col("n_lines").alias(n))
    docs = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in ("n_lines", "n_removed")])
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(t)), "left")
    return out.withColumns(
        {"text": _left(F.col("text"), F.col(r)), "n_lines": F.coalesce(n, F.lit(0)), "n_removed": F.coalesce(F.size(r), F.lit(0)).cast("long")}
    ).drop(i, t, r, n)


@query("op9_line_dedup")
def op9_line_dedup(spark, d):
    return report(table(spark, d, "documents"))


def report(documents: DataFrame) -> DataFrame:
    """Per document row its lines with a word, how many go, the characters of those that stay, and the places of those that go."""
    found = removed_lines(documents.select("doc_id", "text")).withColumnsRenamed({"doc_id": "_id", "t": "_t"})
    docs = documents.select("doc_id", F.xxhash64("text").alias("t"))
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    none = F.array().cast("array<int>")
    return out.select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_chars", F.lit(0)).alias("n_chars_kept"),
        F.array_join(F.coalesce("removed", none).cast("array<string>"), ",").alias("removed"),
    )
