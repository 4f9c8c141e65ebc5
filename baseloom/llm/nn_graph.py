"""Approximate nearest neighbours by inner product: an NN-descent graph, and greedy graph search.

Equal vectors are one point, named by the smallest id; the ``k + 1`` smallest ids of a point are kept, which is all that a result of k
rows can show. Points get one more coordinate that gives all the same length, so that the inner product of two points
falls with their distance; the graph is built on that, while queries, whose last coordinate is 0, are ranked by the plain inner product.

Build: points are dealt to their nearest of ``PIVOTS`` sampled points, large groups at random into parts of ``PART`` at most, and
compared within a part; that is repeated with other pivots and gives the first lists. Then NN-descent: at each point its neighbours and
some reverse neighbours meet, pairs with a new member are compared, and what beats a point's worst neighbour is put into its list, until few
lists change. Search: from the best pivots and the query's own point, the best unexpanded points of a query are
expanded by a join with the graph, until its best ``BEAM`` are all expanded. Each round is written to the shared folder.

Every point is in the graph; the pivots are a sample of bounded size and only start the build and the search. Scores are exact.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do such queries. Repeated rows with one id
count once. Ties go to the smaller id. With fewer than k candidates all are returned that the search reaches; a table of up to ``PART`` points is
compared whole. Vectors must have one length; rows of another length than the most frequent are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baseloom.llm.registry import query, staged, table

K = 20
NEIGHBOURS = 32
REVERSE = 20
PIVOTS = 256
PART = 512
STARTS = 4
ROUNDS = 5
SETTLED = 0.01
BEAM = 128
EXPAND = 32
ENTRIES = 8


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def usable(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part, as doubles; a repeated id keeps its smallest vector."""
    rows = vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (usual[0].d if usual else 0))


def points_of(rows: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Points (u, v, p): distinct vectors with the added coordinate as float64 bytes; members (u, id), the k + 1 smallest ids each."""
    longest = F.sqrt(_dot(F.col("v"), F.col("v")))
    rows = staged(rows.withColumns({"h": F.xxhash64("v"), "length": longest}), "vectors")
    most = rows.agg(F.max("length")).first()[0] or 0.0
    point = rows.groupBy("h").agg(F.min(F.struct("id", "v")).alias("f")).select("h", F.col("f.id").alias("u"), F.col("f.v").alias("v"))
    rank = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    member = rows.select("h", "id").withColumn("r", rank).where(F.col("r") <= k + 1).join(point.select("h", "u"), "h").select("u", "id")
    more = F.sqrt(F.greatest(F.lit(most * most) - _dot(F.col("v"), F.col("v")), F.lit(0.0)))
    return staged(point.select("u", "v", F.concat("v", F.array(more)).alias("p")), "points"), staged(member, "members")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _edges(u, w, s):
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(s, pa.float64())], names=["u", "w", "s"])


def _groups(batches, size):
    """Rows of one key at a time, as lists of arrays; the key is in column 0 and rows come in its order."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if held and held[-1].column(0)[0] != part.column(0)[0]:
                yield held
                held = []
            held.append(part)
    if held:
        yield held


def _stack(parts, i):
    return np.concatenate([_matrix(p.column(i)) if pa.types.is_list(p.column(i).type) else p.column(i).to_numpy(zero_copy_only=False) for p in parts])


def _within(batches):
    """Rows (part, u, p): the best neighbours of each point within its part."""
    for parts in _groups(batches, PART):
        u, p = _stack(parts, 1), _stack(parts, 2)
        for at in range(0, len(u), PART):
            a = p[at : at + PART] @ p.T
            a[np.arange(len(a)), at + np.arange(len(a))] = -np.inf
            n = min(NEIGHBOURS, len(u) - 1)
            if n:
                best = np.argpartition(-a, n - 1, axis=1)[:, :n]
                yield _edges(np.repeat(u[at : at + PART], n), u[best].reshape(-1), np.take_along_axis(a, best, axis=1).reshape(-1))


def _met(batches):
    """Rows (v, u, fresh, worst, p): pairs of neighbours of v, one of them fresh, that beat a worst neighbour."""
    for parts in _groups(batches, 0):
        u, fresh, worst, p = (_stack(parts, i) for i in (1, 2, 3, 4))
        _, one = np.unique(u, return_index=True)
        u, fresh, worst, p = u[one], fresh[one].astype(bool), worst[one], p[one]
        if len(u) < 2 or not fresh.any():
            continue
        s = p @ p.T
        good = (fresh[:, None] | fresh[None, :]) & (s > worst[:, None])
        np.fill_diagonal(good, False)
        i, j = np.nonzero(good)
        if len(i):
            yield _edges(u[i], u[j], s[i, j])


def _best(edges: DataFrame) -> DataFrame:
    """The NEIGHBOURS best (u, w, s, fresh) of each u; an edge that was there before is not fresh."""
    one = edges.groupBy("u", "w").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "w"))
    return one.withColumn("r", rank).where(F.col("r") <= NEIGHBOURS).drop("r")


def _pivots(points: DataFrame, n: int, salt: int) -> np.ndarray:
    chosen = points.orderBy(F.xxhash64("u", F.lit(salt)), "u").limit(n).collect()
    return np.array([r.u for r in chosen], "i8"), np.array([r.p for r in chosen], "f8")


def build(points: DataFrame) -> DataFrame:
    """The neighbour graph (u, w, s): at most NEIGHBOURS rows per point."""
    total = points.count()
    first = None
    for start in range(1 if total <= PART else STARTS):
        _, centres = _pivots(points, 1 if total <= PART else min(PIVOTS, max(1, total // 64)), start)

        def deal(batches, centres=centres):
            for batch in batches:
                near = np.argmax(_matrix(batch.column(1)) @ centres.T, axis=1) if batch.num_rows else np.zeros(0, "i8")
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), *batch.columns], names=["c", "u", "p"])

        dealt = points.select("u", "p").mapInArrow(deal, "c long, u long, p array<double>")
        sizes = dealt.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))  # one row per pivot
        part = F.concat_ws("-", "c", F.pmod(F.xxhash64("u", F.lit(start)), F.col("parts")))
        parts = dealt.join(F.broadcast(sizes), "c").select(F.xxhash64(part).alias("part"), "u", "p")
        found = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_within, "u long, w long, s double")
        first = found if first is None else first.unionByName(found)
    graph = staged(_best(first.withColumn("fresh", F.lit(1))), "graph")
    if total <= PART:
        return graph.drop("fresh")
    for _ in range(ROUNDS):
        worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("s")).otherwise(F.lit(float("-inf"))).alias("worst"))
        info = points.select("u", "p").join(worst, "u")
        reverse = graph.select(F.col("w").alias("v"), "u", "fresh")
        rank = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", "v"), "u"))
        reverse = reverse.withColumn("r", rank).where(F.col("r") <= REVERSE).drop("r")
        meet = graph.select(F.col("u").alias("v"), F.col("w").alias("u"), "fresh").unionByName(reverse)
        meet = meet.join(info, "u").select("v", "u", "fresh", "worst", "p")
        met = meet.repartition("v").sortWithinPartitions("v").mapInArrow(_met, "u long, w long, s double")
        old = graph.withColumn("fresh", F.lit(0))
        graph = staged(_best(old.unionByName(met.withColumn("fresh", F.lit(1)))), "graph")
        changed, size = graph.agg(F.sum("fresh"), F.count(F.lit(1))).first()
        if not size or changed <= SETTLED * size:
            break
    return graph.drop("fresh")


def search(points: DataFrame, graph: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(q, u, s): the best points of each query (q, v, home); home is the query's own point, or null. Scores are plain inner products."""
    beam = max(BEAM, 2 * k)
    names, centres = _pivots(points, PIVOTS, 0)

    def enter(batches):
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            q, home = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            s = _matrix(batch.column(1)) @ centres[:, :-1].T
            best = np.argsort(-s, axis=1)[:, :ENTRIES]
            rows = {(int(a), int(names[b])) for a, bs in zip(q, best) for b in bs} | {(int(a), h) for a, h in zip(q, home) if h is not None}
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["q", "u"])

    vectors, asked = points.select("u", "v"), queries.select("q", F.col("v").alias("x"))

    def scored(pairs):
        return pairs.join(vectors, "u").join(asked, "q").select("q", "u", _dot(F.col("v"), F.col("x")).alias("s"))

    state = staged(scored(queries.select("q", "v", "home").mapInArrow(enter, "q long, u long")).withColumn("done", F.lit(0)), "search")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "u")
    while True:
        open_ = state.where("done = 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= EXPAND).select("q", "u")
        found = open_.join(graph.select("u", "w"), "u").select("q", F.col("w").alias("u")).distinct().join(state.select("q", "u"), ["q", "u"], "left_anti")
        marked = state.join(open_.withColumn("now", F.lit(1)), ["q", "u"], "left").select("q", "u", "s", F.greatest("done", F.coalesce("now", F.lit(0))).alias("done"))
        both = marked.unionByName(scored(found).withColumn("done", F.lit(0)))
        # What falls out of the beam stays known as long as it could come back, which it cannot: beams only get better.
        state = staged(both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam).drop("r"), "search")
        if not state.where("done = 0").limit(1).count():
            return state.select("q", "u", "s")


def nearest(vectors: DataFrame, asked: Column, k: int = K, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``asked`` (on the column id) chooses, its k nearest other rows."""
    rows = staged(usable(vectors, id_, vector), "usable")
    points, member = points_of(rows, k)
    graph = build(points)
    home = points.select(F.xxhash64("v").alias("h"), F.col("u").alias("home"))
    queries = staged(rows.where(asked).withColumn("h", F.xxhash64("v")).join(home, "h", "left").select(F.col("id").alias("q"), "v", "home"), "queries")
    found = search(points, graph, queries, k).join(member, "u").where(F.col("id") != F.col("q"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("s").alias("score"))


@query("op10_nn_graph")
def op10_nn_graph(spark, d):
    return nearest(table(spark, d, "embeddings"), F.col("id") % 20 == 0)
