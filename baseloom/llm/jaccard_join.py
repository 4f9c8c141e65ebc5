"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct five-word shingles. Two documents link when their sets' Jaccard similarity is at
least 75 percent. The join is exact up to collisions of 64-bit hashes.

1. Equal sets are one class, by fingerprint; one member stands for all.
2. Candidates meet through a prefix of their shingles: of a set of n, the first floor(n/4)+1 in an order common to all
   documents hold a shared one if the sets link. Shingles with low hashes, at least three tenths of all, come first, the
   rarer the earlier; so a passage that many documents share is no meeting point while rarer shingles are left.
   The document frequency is counted over all documents.
3. Tokens are hashed into 128 groups; the group counts of a document are its point. The sum of coordinate minima with
   the upper corner of a tree node bounds the overlap with all points below it.
4. Star search: the members of a key's group are packed into nodes by size and searched for one hub, the member with the
   fewest shingles of its own. That links most of a family of copies with at most as many pairs as members.
5. Groups that still hold several components are searched for every point. Up to ``NODE`` members are paired where they
   meet. More are dealt to leaves by component and size, leaf pairs that cannot hold a new link go, and each remaining
   pair of leaves is one task with an R-tree. A pair is put out by the first key of such groups that both share.
6. Pairs are verified on the shingle sets of whole texts, which are cut once per document and written by bucket, so that
   only pairs move. Most pairs of step 5 link nothing; they are first compared by 16 bits of each shingle, which bounds
   the overlap, so that few whole sets go along. Links are closed to components.

No step gathers a group: a class is cut to one row per task before the shuffle, hot groups are split into leaf pairs.
Texts that no pair needs are left out by a bitmap of hashes before they would move.

Defined cases: A-Z count as lower case. Null texts and texts without words have an empty set and link with nothing;
with fewer than five words the whole sequence is the one shingle. Repeated rows fall in one class. An empty table gives an empty result.
Null ids form classes like others, the smallest known id names a component. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baseloom.llm.components import column, components
from baseloom.llm.registry import WORD, fresh, let, lower_ascii, once, query, staged, table
from baseloom.session import scratch_path

N = 5
DIMENSIONS = 128
LEAF = 2048
NODE = 32
# Share of the hash range whose shingles are ordered by document frequency.
RANKED = 0.3
_CUT = -(2**63) + int(RANKED * 2**64)
# Bits of the largest bitmap that sifts texts: 8 MB. Beyond that more texts move than need to.
MOST_BITS = 26
# A run of one key longer than this passes the size check whole.
LONG_RUN = 100_000
# A run of one key longer than this counts as equally frequent with all such runs, so that a run need not be held.
_LONG_RUN = 500_000


def shingles(text: Column, n: int = N) -> Column:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""

    def build(words):
        grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
        short = F.array(F.xxhash64(F.lit("short"), words))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(words) == 0, none).when(F.size(words) < n, short).otherwise(F.sort_array(F.array_distinct(grams)))

    return let(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), build)


def packed_counts(h: np.ndarray) -> bytes:
    """The counts per token group, one byte each where they fit, else four."""
    counts = np.bincount((h & (DIMENSIONS - 1)).astype("i8"), minlength=DIMENSIONS)
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def counts_of(vectors: pa.Array) -> np.ndarray:
    """One row of counts for each of the ``packed_counts``."""
    rows = vectors.to_pylist()
    out = np.empty((len(rows), DIMENSIONS), "i4")
    wide = np.array([len(x) > DIMENSIONS for x in rows], bool)
    for which, kind in ((~wide, "u1"), (wide, "<u4")):
        out[which] = np.frombuffer(b"".join(x for x, w in zip(rows, which) if w), kind).reshape(-1, DIMENSIONS)
    return out


def _prepared(batches):
    """Rows (doc_id, f, t, h): per document its class, its text's hash and its set size; with the first of a class in a task also the
    number of ranked shingles, the counts per token group, and the shingles that can be keys. Copies carry nothing more.
    """
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            lists = part.column(3)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            low, vectors, keys = [], [], []
            for f, lo, hi in zip(part.column(1).to_pylist(), offsets[:-1], offsets[1:]):
                if f is None or f in seen:
                    low.append(None), vectors.append(None), keys.append(None)
                    continue
                seen.add(f)
                h = flat[lo:hi]
                a = int(np.searchsorted(h, _CUT))
                low.append(a)
                keys.append(h[: max(a, len(h) // 4 + 1)])
                vectors.append(packed_counts(h))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(low, pa.int64()),
                 pa.array(vectors, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "f", "t", "n", "a", "vector", "keys"],
            )


def _hopeful(batches):
    """Rows (key, f, n, room, component) in key order: those that could link to another component of their key's group.

    Room is the number of a document's shingles from the key on; at the first key that two documents share, it bounds their
    overlap. Groups of more than ``NODE`` members pass whole; the tree prunes them.
    """
    held, hot = None, None
    for batch in batches:
        if hot is not None and batch.num_rows:
            same = int(np.searchsorted(batch.column(0).to_numpy(zero_copy_only=False), hot, side="right"))
            yield batch.slice(0, same)
            batch = batch.slice(same)
            if not batch.num_rows:
                continue
            hot = None
        held = batch if held is None else pa.concat_batches([held, batch])
        key = held.column(0).to_numpy(zero_copy_only=False)
        edge = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if edge:
            yield _with_partner(held.slice(0, edge))
            held = held.slice(edge)
        elif held.num_rows > LONG_RUN:
            # The run of a hot key passes whole, so that it need not be held.
            yield held
            hot, held = key[-1], None
    if held is not None and held.num_rows:
        yield _with_partner(held)


def small_pairs(key: np.ndarray, most: int = NODE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i, j), i before j, inside each run of equal keys of at most ``most`` rows, and which rows lie in longer runs."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    long = np.repeat(sizes > most, sizes)
    end = np.repeat(starts + sizes, sizes)
    after = np.where(long, 0, end - np.arange(len(key)) - 1)
    i = np.repeat(np.arange(len(key)), after)
    first = np.repeat(np.cumsum(after) - after, after)
    return i, i + 1 + np.arange(len(i)) - first, long


def _partners(batch):
    """Index pairs that could link in groups of at most ``NODE`` rows, and which rows lie in longer ones."""
    key, n, room, part = (column(batch, c) for c in (0, 2, 3, 4))
    i, j, long = small_pairs(key)
    fit = (part[i] != part[j]) & (7 * np.minimum(room[i], room[j]) >= 3 * (n[i] + n[j])) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
    return i[fit], j[fit], long


def _with_partner(batch):
    i, j, good = _partners(batch)
    good[i] = True
    good[j] = True
    return batch.filter(pa.array(good, pa.bool_()))


def _met(batches):
    """Rows (key, f, n, room, component, other): the ``_hopeful`` rows of groups of more than ``NODE``, without other; and of the smaller groups
    each pair (f, other) that could link, once in a batch.
    """
    held, hot = None, None

    def out(batch, parts):
        i, j, long = _partners(batch)
        # Of these runs, other parts lie in the batches before and after.
        long |= np.isin(column(batch, 0), [k for k in parts if k is not None])
        i, j = i[~long[i]], j[~long[i]]
        f = column(batch, 1)
        pairs = np.unique(np.stack([np.minimum(f[i], f[j]), np.maximum(f[i], f[j])], axis=1), axis=0)
        rows, none = batch.filter(pa.array(long, pa.bool_())), pa.nulls(len(pairs), pa.int64())
        columns = [(none, c) for c in rows.columns]
        columns[1] = (pa.array(pairs[:, 0], pa.int64()), rows.column(1))
        columns.append((pa.array(pairs[:, 1], pa.int64()), pa.nulls(rows.num_rows, pa.int64())))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["key", "f", "n", "room", "component", "other"])

    for batch in _hopeful(batches):
        held = batch if held is None else pa.concat_batches([held, batch])
        if not held.num_rows:
            continue
        key = column(held, 0)
        edge = int(np.searchsorted(key, key[-1]))
        if held.num_rows - edge > NODE or key[-1] == hot:
            edge, last = held.num_rows, key[-1]
        else:
            last = None
        if edge:
            yield out(held.slice(0, edge), (hot, last))
            held = held.slice(edge)
            hot = last
    if held is not None and held.num_rows:
        yield out(held, (hot,))


def _hubbed(batches):
    """Rows (key, f, n, own) in the order of key, own and f: (hub, f) for each member of a group that could link with the group's first, its hub."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, f, n = (column(batch, c) for c in range(3))
        starts = np.flatnonzero(np.r_[last is None or key[0] != last[0], key[1:] != key[:-1]])
        # The run that goes on from the batch before keeps its hub.
        hubs, hub_ns = np.r_[0 if last is None else last[1], f[starts]], np.r_[0 if last is None else last[2], n[starts]]
        run = np.searchsorted(starts, np.arange(len(key)), side="right")
        hub, hub_n = hubs[run], hub_ns[run]
        last = key[-1], hub[-1], hub_n[-1]
        good = (f != hub) & (4 * np.minimum(n, hub_n) >= 3 * np.maximum(n, hub_n))
        yield pa.RecordBatch.from_arrays([pa.array(hub[good], pa.int64()), pa.array(f[good], pa.int64())], names=["hub", "f"])


def _shared(batches):
    """Rows (key, f) in key order: those whose key has several members, with their number."""
    held_k, held_f, long_key = np.zeros(0, "i8"), np.zeros(0, "i8"), None

    def out(k, f, df):
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(f, pa.int64()), pa.array(df, pa.int64())], names=["key", "f", "df"])

    def counted(k, f):
        if not len(k):
            return None
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        df = np.repeat(np.diff(np.r_[starts, len(k)]), np.diff(np.r_[starts, len(k)]))
        good = df > 1
        return out(k[good], f[good], df[good]) if good.any() else None

    last = None
    for batch in batches:
        k, f = column(batch, 0), column(batch, 1)
        if not len(k):
            continue
        fresh = np.r_[last is None or (k[0], f[0]) != last, (k[1:] != k[:-1]) | (f[1:] != f[:-1])]
        last = (k[-1], f[-1])
        k, f = k[fresh], f[fresh]
        if long_key is not None:
            same = k == long_key
            if same.any():
                yield out(k[same], f[same], np.full(same.sum(), _LONG_RUN))
            k, f = k[~same], f[~same]
            if len(k):
                long_key = None
        if not len(k):
            continue
        k, f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
        edge = np.searchsorted(k, k[-1])
        if (got := counted(k[:edge], f[:edge])) is not None:
            yield got
        held_k, held_f = k[edge:], f[edge:]
        if len(held_k) >= _LONG_RUN:
            long_key = held_k[0]
            yield out(held_k, held_f, np.full(len(held_k), _LONG_RUN))
            held_k, held_f = np.zeros(0, "i8"), np.zeros(0, "i8")
    if (got := counted(held_k, held_f)) is not None:
        yield got


def _bounded(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) have a sum of coordinate minima of at least ``need`` sevenths."""
    good = np.zeros(len(i), bool)
    for at in range(0, len(i), 8192):
        p = slice(at, at + 8192)
        good[p] = 7 * np.minimum(a[i[p]], b[j[p]]).sum(axis=1, dtype="i8") >= need[p]
    return good


def tree_pairs(vectors: np.ndarray, sizes: np.ndarray, parts: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Pairs (i, j) of points, i from ``left`` and j from ``right``, that the bound lets through.

    A packed R-tree over ``right``: points in the order of size, ``NODE`` to a node, a node's upper corner the maximum of its points.
    Pairs of one component are left out.
    """
    right = right[np.argsort(sizes[right], kind="stable")]
    starts = np.arange(0, len(right), NODE)
    out_i, out_j = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    if not len(starts):
        return out_i[0], out_j[0]
    upper = np.maximum.reduceat(vectors[right], starts, axis=0)
    least, most = sizes[right][starts], sizes[right][np.minimum(starts + NODE, len(right)) - 1]
    for at in range(0, len(left), 256):
        own = left[at : at + 256]
        n = sizes[own][:, None]
        i, node = np.nonzero((4 * most[None, :] >= 3 * n) & (3 * least[None, :] <= 4 * n))
        i = own[i]
        # A partner has at least the node's smallest size, and at least three quarters of the point's own.
        need = 3 * (sizes[i] + np.maximum(least[node], (3 * sizes[i] + 3) // 4))
        good = _bounded(vectors, upper, i, node, need)
        i, node = i[good], node[good]
        j = starts[node][:, None] + np.arange(NODE)[None, :]
        i = np.broadcast_to(i[:, None], j.shape)[j < len(right)]
        j = right[j[j < len(right)]]
        fit = (parts[i] != parts[j]) & (4 * np.minimum(sizes[i], sizes[j]) >= 3 * np.maximum(sizes[i], sizes[j]))
        i, j = i[fit], j[fit]
        good = _bounded(vectors, vectors, i, j, 3 * (sizes[i] + sizes[j]))
        out_i.append(i[good]), out_j.append(j[good])
    return np.concatenate(out_i), np.concatenate(out_j)


def hub_search(hub: np.ndarray, n: np.ndarray, hub_n: np.ndarray, own: np.ndarray, of_hub: np.ndarray) -> np.ndarray:
    """Which rows can link with their hub, by the bound; rows lie in the order of hub and size.

    Each run of one hub is a packed tree with ``NODE`` rows to a node; rows of a node that fails are not looked at.
    """
    if not len(hub):
        return np.zeros(0, bool)
    begin = np.flatnonzero(np.r_[True, hub[1:] != hub[:-1]])
    place = np.arange(len(hub)) - np.repeat(begin, np.diff(np.r_[begin, len(hub)]))
    starts = np.flatnonzero(place % NODE == 0)
    upper = np.maximum.reduceat(own, starts, axis=0)
    need = 3 * (hub_n[starts] + np.maximum(n[starts], (3 * hub_n[starts] + 3) // 4))
    open_ = _bounded(upper, of_hub, np.arange(len(starts)), starts, need)
    good = np.repeat(open_, np.diff(np.r_[starts, len(hub)]))
    rows = np.flatnonzero(good)
    good[rows] = _bounded(own, of_hub, rows, rows, 3 * (n[rows] + hub_n[rows]))
    return good


def _starred(batches):
    """Rows (hub, f, n, hub_n, vector, hub_vector) in the order of hub and n: the pairs (a, b) that the bound lets through."""
    for batch in batches:
        hub, f, n, hub_n = (column(batch, c) for c in range(4))
        own, of_hub = (counts_of(batch.column(c)) for c in (4, 5))
        good = hub_search(hub, n, hub_n, own, of_hub)
        a, b = np.minimum(hub[good], f[good]), np.maximum(hub[good], f[good])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _searched(batches):
    """Rows (key, l, r, side, f, n, component, vector, earlier, room) in the order of key, l, r: candidate pairs of each pair of leaves.

    Earlier are a document's hopeful keys before this one; a pair that shares one of them was looked at there. Room bounds the overlap as
    in ``_hopeful``.

    Groups of at most ``NODE`` points are one node of a tree; many of them are compared at once.
    """

    def found(held):
        key, l, r, side, f, n, part = (held.column(c).to_numpy(zero_copy_only=False) for c in range(7))
        vectors, room = counts_of(held.column(7)), column(held, 9)
        lists = held.column(8)
        values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        task = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (l[1:] != l[:-1]) | (r[1:] != r[:-1])])
        i, j, long = small_pairs(task)
        fit = (part[i] != part[j]) & ((l[i] == r[i]) | (side[i] != side[j]))
        fit &= 4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])
        i, j = i[fit], j[fit]
        good = _bounded(vectors, vectors, i, j, 3 * (n[i] + n[j]))
        first, second = [i[good]], [j[good]]
        for t in np.unique(task[long]):
            lo, hi = np.searchsorted(task, [t, t + 1])
            rows = np.arange(lo, hi)
            left = rows[side[lo:hi] == 0]
            right = left if l[lo] == r[lo] else rows[side[lo:hi] == 1]
            p, q = tree_pairs(vectors, n, part, left, right)
            once_only = (p < q) | (l[lo] != r[lo])
            first.append(p[once_only]), second.append(q[once_only])
        a, b, sets, orders = [], [], {}, {}
        i, j = np.concatenate(first), np.concatenate(second)
        fit = 7 * np.minimum(room[i], room[j]) >= 3 * (n[i] + n[j])
        for p, q in zip(i[fit].tolist(), j[fit].tolist()):
            if p not in sets:
                sets[p] = set(values[offsets[p] : offsets[p + 1]].tolist())
            if q not in orders:
                orders[q] = values[offsets[q] : offsets[q + 1]].tolist()
            if sets[p].isdisjoint(orders[q]):
                a.append(min(f[p], f[q])), b.append(max(f[p], f[q]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        if held.num_rows < LEAF:
            continue
        key, l, r = (held.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        # The last group may go on in the next batch.
        edge = int(np.flatnonzero((key == key[-1]) & (l == l[-1]) & (r == r[-1]))[0])
        if edge:
            yield found(held.slice(0, edge))
            held = held.slice(edge)
    if held is not None and held.num_rows:
        yield found(held)


def leaf_tasks(members: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Rows (key, l, r, side, f): members (key, f, n, component) of groups with several components, dealt to pairs of leaves.

    Leaves hold at most ``leaf`` members in the order of component and size. Pairs of leaves whose sizes cannot match, or that hold one and
    the same component, are left out. A group of any size becomes tasks of bounded size.
    """
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    order = Window.partitionBy("key").orderBy("component", "n", "f")
    dealt = staged(members.join(mixed, "key").withColumn("leaf", F.floor((F.row_number().over(order) - 1) / leaf)), "leaves")
    leaves = dealt.groupBy("key", "leaf").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    l, r = leaves.alias("l"), leaves.alias("r")
    leaf_pairs = (
        l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.leaf") <= F.col("r.leaf")))
        .where("4 * l.most >= 3 * r.least and 4 * r.most >= 3 * l.least and not (l.lo = r.hi and l.hi = r.lo)")
        .select("l.key", F.col("l.leaf").alias("l"), F.col("r.leaf").alias("r"))
    )
    side = lambda name, n: dealt.join(leaf_pairs.withColumn("leaf", F.col(name)), ["key", "leaf"]).select("key", "l", "r", F.lit(n).alias("side"), "f")
    return side("l", 0).unionByName(side("r", 1).where("l != r"))


def _bucketed(df: DataFrame, key: str) -> str:
    """Write a table bucketed by a key, so that joins on it move the other side only; returns its name in the catalogue."""
    spark, name = df.sparkSession, fresh("sets").strip("_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, f"llm-{name}")).saveAsTable(name)
    return name


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (f, h) link."""
    left = pairs.join(sets.select(F.col("f").alias("a"), F.col("h").alias("p")), "a")
    both = left.join(sets.select(F.col("f").alias("b"), F.col("h").alias("q")), "b")
    sizes = once(both, "o", F.size(F.array_intersect("p", "q")))
    return sizes.where(100 * F.col("o") >= 75 * (F.size("p") + F.size("q") - F.col("o"))).select("a", "b")


def sketch(h: Column) -> Column:
    """The distinct last 16 bits of the hashes."""
    return F.array_distinct(F.transform(h, lambda x: (x.bitwiseAND(0xFFFF) - 0x8000).cast("smallint")))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that can link by the sketches of their sets (f, n, s): all that do, and few others.

    Shared shingles have shared bits; no more of them are lost by equal bits than a set has shingles beyond its sketch.
    """
    left = pairs.join(sets.select(F.col("f").alias("a"), F.col("n").alias("m"), F.col("s").alias("p")), "a")
    both = left.join(sets.select(F.col("f").alias("b"), "n", F.col("s").alias("q")), "b")
    most = F.size(F.array_intersect("p", "q")) + F.least(F.col("m") - F.size("p"), F.col("n") - F.size("q"))
    return both.where(7 * most >= 3 * (F.col("m") + F.col("n"))).select("a", "b")


def sifted(df: DataFrame, value: Column, wanted: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Rows of a table whose hash may be one of the wanted, a table of one long column: all that are, and few others.

    The wanted hashes set bits of a bitmap of 16 times as many bits, as far as ``most_bits`` allow, which is broadcast in rows of 4 KB.
    """
    bits = max(15, min(most_bits, (16 * wanted.count()).bit_length()))
    place, bucket, bitmap = fresh("place"), fresh("bucket"), fresh("bitmap")
    cut = lambda c: c.bitwiseAND((1 << bits) - 1)
    placed = wanted.select(cut(F.col(wanted.columns[0])).alias(place))
    maps = placed.groupBy(F.bitmap_bucket_number(place).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bitmap))
    at = F.bitmap_bit_position(cut(value))
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    return df.join(F.broadcast(maps), (F.bitmap_bucket_number(cut(value)) == F.col(bucket)) & hit, "left_semi")


def prepare(documents: DataFrame) -> DataFrame:
    """(doc_id, f, t, n, a, vector, keys): see ``_prepared``; f is the fingerprint of a document's set, null for an empty one."""
    sets = once(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text"), "h", shingles(F.col("text")))
    sets = sets.select("doc_id", F.when(F.size("h") > 0, F.xxhash64("h")).alias("f"), "t", "h")
    return staged(sets.mapInArrow(_prepared, "doc_id long, f long, t long, n long, a long, vector binary, keys array<long>"), "prepared")


def links(documents: DataFrame, everything: DataFrame) -> DataFrame:
    """Verified links (a, b) between fingerprints that join all linked classes into their components."""
    prepared = everything.where("keys is not null")
    shared = staged(
        prepared.select(F.explode("keys").alias("key"), "f").repartition("key").sortWithinPartitions("key", "f").mapInArrow(_shared, "key long, f long, df long"),
        "shared",
    )
    # The prefix of each document: unique shingles first, then the ranked ones by frequency, then the others by hash.
    nodes = prepared.groupBy("f").agg(F.first("n").alias("n"), F.first("a").alias("a"), F.first("vector").alias("vector"), F.first("t").alias("t"))
    ranked = F.col("key") < _CUT
    found = shared.groupBy("f").agg(
        F.sort_array(F.collect_list(F.when(ranked, F.struct("df", "key")))).alias("low"),
        F.sort_array(F.collect_list(F.when(~ranked, F.col("key")))).alias("high"),
    )
    own = F.col("a") - F.size("low")
    room = F.greatest(F.floor(F.col("n") / 4) + 1 - own, F.lit(0)).cast("int")
    prefix = F.concat(F.slice("low", 1, room)["key"], F.col("high"))
    points = nodes.join(found, "f").select(
        F.col("t").alias("f"), F.col("f").alias("class"), "n", "vector", own.alias("before"), (own / F.greatest("a", F.lit(1))).alias("own"), prefix.alias("keys")
    )
    # From here to the end, the hash of one of its texts stands for a class, so that a text moves once, by its own hash.
    points = staged(points.where(F.size("keys") > 0), "points")
    rows = points.select(F.explode("keys").alias("key"), "f", "n", "own")
    star = rows.repartition("key").sortWithinPartitions("key", "own", "f").mapInArrow(_hubbed, "hub long, f long")
    star = star.groupBy(F.least("f", "hub").alias("a"), F.greatest("f", "hub").alias("b")).agg(F.min("hub").alias("hub"))
    star = star.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("f"))
    star = star.join(points.select(F.col("f").alias("hub"), F.col("n").alias("hub_n"), F.col("vector").alias("hub_vector")), "hub")
    star = star.join(points.select("f", "n", "vector"), "f").select("hub", "f", "n", "hub_n", "vector", "hub_vector")
    star = staged(star.sortWithinPartitions("hub", "n").mapInArrow(_starred, "a long, b long"), "stars")

    # One text of each class that shares a key.
    texts = sifted(documents.select("text"), F.xxhash64("text"), points.select("f")).select(F.xxhash64("text").alias("f"), "text").dropDuplicates(["f"])
    texts = texts.join(points.select("f"), "f", "left_semi")
    # Sets are cut once and moved no more: both verifications read them by bucket.
    cut = once(texts, "h", shingles(F.col("text"))).select("f", F.size("h").alias("n"), sketch(F.col("h")).alias("s"), "h")
    kept = _bucketed(cut, "f")
    sets = documents.sparkSession.table(kept)
    first = staged(_verified(staged(_alike(star, sets), "alike"), sets), "star")
    linked = components(first)

    # Groups that hold several components, dealt to leaves by component and size.
    known = points.drop("class").join(linked.select(F.col("node").alias("f"), "component"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    known = staged(known, "known")
    members = known.select(F.posexplode("keys").alias("at", "key"), "f", "n", "before", "component")
    members = members.select("key", "f", "n", (F.col("n") - F.col("before") - F.col("at")).alias("room"), "component")
    met = members.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "key long, f long, n long, room long, component long, other long")
    met = staged(met, "met")
    near, hopeful = met.where("other is not null").select(F.col("f").alias("a"), F.col("other").alias("b")), met.where("other is null").drop("other")
    tasks = leaf_tasks(hopeful.drop("room"))
    # A pair that links is hopeful, on both sides, at the first key that it shares; there it is one of the near pairs, or the key goes along.
    order = hopeful.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("room", "key")), asc=False).alias("order"))
    known = known.join(order, "f").select("f", "n", "component", "vector", F.col("order")["key"].alias("keys"), F.col("order")["room"].alias("rooms"))
    place = F.array_position("keys", F.col("key")).cast("int")
    tasks = tasks.join(known, "f").select(
        "key", "l", "r", "side", "f", "n", "component", "vector", F.slice("keys", 1, place - 1).alias("earlier"), F.element_at("rooms", place).alias("room")
    )
    searched = tasks.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r", "side").mapInArrow(_searched, "a long, b long")
    searched = staged(searched.unionByName(near).distinct(), "searched")
    second = _verified(staged(_alike(searched, sets), "alike"), sets)
    out = first.unionByName(second)
    for end in ("a", "b"):
        out = out.join(points.select(F.col("f").alias(end), "class"), end).drop(end).withColumnRenamed("class", end)
    out = staged(out, "links")
    documents.sparkSession.sql(f"DROP TABLE IF EXISTS {kept}")
    return out


def join_classes(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    member = prepare(documents)
    linked = components(links(documents, member)).withColumnRenamed("node", "f")
    named = member.where("f is not null").groupBy("f").agg(F.min("doc_id").alias("rep"))
    named = named.join(linked, "f", "left").withColumn("component", F.coalesce("component", "f"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("f", "component_id")
    return member.join(named, "f", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


@query("op1_jaccard_join")
def op1_jaccard_join(spark, d):
    return join_classes(table(spark, d, "documents"))
