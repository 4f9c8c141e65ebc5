"""Interval labels of trees: descendants by ranges, sums over subtrees by differences.

A walk round a tree passes each node twice, downward and upward. The number of a step in this walk gives a node its
``enter`` and ``leave``; what lies below the node lies between them. Steps know only the step after them, so the walk is
numbered by list ranking. First each block of 65,536 steps is followed on its own, until the walk leaves it; siblings are numbered one
after another, so a walk stays in a block for long. The steps at which blocks are entered are then ranked by rounds in which a step's
successor becomes the successor's successor. Trees of any depth take at most log2(steps) rounds, a comb as well as a
star, one block takes none, and no list of ancestors is built.

Several trees count as one below a root of their own. A node with two parents, or on a cycle, is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baseloom.functions.names import is_tip
from baseloom.operators.ranking import assign_pk
from baseloom.session import stored

BLOCK = 1 << 16
LEVELS = 12


def _steps(numbered: DataFrame) -> DataFrame:
    """(step, next) of the walk; a node n is passed down by step 2n and up by step 2n + 1. The last step has no next."""
    # Siblings have consecutive numbers, so the next one is a key look-up, however many a parent has.
    after = numbered.select((F.col("n") - 1).alias("n"), F.col("p").alias("p2"))
    first = numbered.groupBy("p").agg(F.min("n").alias("first")).withColumnRenamed("p", "of")
    joined = numbered.join(after, "n", "left").join(first, F.col("n") == F.col("of"), "left")
    down, up = F.col("n") * 2, F.col("n") * 2 + 1
    over = F.when(F.col("p2") == F.col("p"), (F.col("n") + 1) * 2).when(F.col("p") != 0, F.col("p") * 2 + 1)
    return joined.select(
        F.inline(
            F.array(
                F.struct(down.alias("step"), F.coalesce(F.col("first") * 2, up).alias("next")),
                F.struct(up.alias("step"), over.alias("next")),
            )
        )
    )


def _follower(size: int):
    """Per step of a block: the step outside that the walk comes to from it (null at the end), and the number of steps until then."""

    def follow(key, block):
        import numpy as np
        import pandas as pd

        step = block["step"].to_numpy()
        base = int(key[0]) * size
        at = np.full(size, -1)
        at[step - base] = np.arange(len(step))
        following = block["next"].fillna(-1).to_numpy().astype("i8")
        left = (following >= 0).astype("i8")
        for _ in range(size.bit_length() + 1):
            inside = (following >= base) & (following < base + size)
            if not inside.any():
                break
            to = at[following[inside] - base]
            left[inside] += left[to]
            following[inside] = following[to]
        else:
            raise ValueError("the edges hold a cycle")
        return pd.DataFrame({"step": step, "next": pd.Series(following, dtype="Int64").mask(following < 0), "left": left})

    return follow


def _ranked(steps: DataFrame) -> DataFrame:
    """(step, left): how many steps come after each step."""
    blocks = steps.groupBy(F.floor(F.col("step") / BLOCK).alias("block"))
    local = stored(blocks.applyInPandas(_follower(BLOCK), "step long, next long, left long"))
    entries = local.where("next IS NOT NULL").select(F.col("next").alias("step")).distinct()
    now = stored(local.join(entries, "step", "left_semi"))
    size, reach = now.count(), 1
    while not now.where("next IS NOT NULL").isEmpty():
        if reach > 2 * size:
            raise ValueError("the edges hold a cycle")
        after = now.select(F.col("step").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        now = stored(
            now.join(after, "next", "left").select(
                "step", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")
            )
        )
        reach *= 2
    rest = now.select(F.col("step").alias("next"), F.col("left").alias("_left"))
    return local.join(rest, "next", "left").select("step", (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"))


def interval_labels(edges: DataFrame) -> DataFrame:
    """(node, parent, enter, leave) of every node of ``child, parent`` edges; roots have a null parent.

    ``enter`` and ``leave`` are all different and count from 0; the nodes below a node are those that it encloses.
    """
    edges = stored(edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct())
    if twice := edges.groupBy("child").count().where("count > 1").head(1):
        raise ValueError(f"node {twice[0]['child']!r} has more than one parent")
    roots = edges.select("parent").distinct().join(edges.select(F.col("child").alias("parent")), "parent", "left_anti")
    if roots.isEmpty() and not edges.isEmpty():
        raise ValueError("the edges hold a cycle")
    kind = edges.schema["child"].dataType
    nodes = edges.select(F.col("child").alias("node"), "parent").unionByName(
        roots.select(F.col("parent").alias("node"), F.lit(None).cast(kind).alias("parent"))
    )
    keyed = nodes.withColumns({"_child": F.col("parent").isNotNull().cast("int"), "_parent": F.coalesce("parent", "node")})
    named = stored(assign_pk(keyed, ["_child", "_parent", "node"], "n").select("node", "parent", "n"))
    above = named.select(F.col("node").alias("parent"), F.col("n").alias("p"))
    numbered = stored(named.join(above, "parent", "left").select("n", F.coalesce("p", F.lit(0)).cast("bigint").alias("p")))
    ranked = _ranked(_steps(numbered))
    total = 2 * named.count()
    at = ranked.select(F.floor(F.col("step") / 2).alias("n"), (F.col("step") % 2).alias("up"), (F.lit(total - 1) - F.col("left")).alias("at"))
    at = at.groupBy("n").agg(F.min(F.when(F.col("up") == 0, F.col("at"))).alias("enter"), F.max(F.when(F.col("up") == 1, F.col("at"))).alias("leave"))
    labels = stored(named.join(at, "n").select("node", "parent", "enter", "leave"))
    # A cycle beside a tree is a walk of its own and ends nowhere.
    if labels.where("enter IS NULL OR leave IS NULL OR enter < 0").head(1):
        raise ValueError("the edges hold a cycle")
    return labels


def _before(labels: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(at, sums): per step of the walk the sums over nodes entered before it, by blocks of steps."""
    zero = {name: F.lit(0).cast(labels.select(v.alias(name)).schema[name].dataType) for name, v in values.items()}
    steps = labels.select(F.col("enter").alias("at"), *[v.alias(n) for n, v in values.items()]).unionByName(
        labels.select(F.col("leave").alias("at"), *[z.alias(n) for n, z in zero.items()])
    )
    steps = stored(steps.withColumn("block", F.floor(F.col("at") / BLOCK)))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of 65,536 steps.
    blocks = steps.groupBy("block").agg(*[F.sum(n).alias(f"_{n}") for n in values])
    blocks = blocks.select("block", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in values])
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    running = steps.select("block", "at", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in values])
    return running.join(blocks, "block").select("at", *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in values])


def subtree_sums(labels: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``labels`` with, per name, the sum of a value over all nodes below each node (without its own)."""
    before = stored(_before(labels, values))
    low = before.select(F.col("at").alias("enter"), *[F.col(n).alias(f"_low_{n}") for n in values])
    high = before.select(F.col("at").alias("leave"), *[F.col(n).alias(f"_high_{n}") for n in values])
    joined = labels.join(low, "enter").join(high, "leave")
    return joined.select(*labels.columns, *[(F.col(f"_high_{n}") - F.col(f"_low_{n}") - v).alias(n) for n, v in values.items()])


def tip_signatures(labels: DataFrame) -> DataFrame:
    """Per node with tips below it their number and an order-free signature of their set.

    Two 64-bit hash sums and the count stand for the set.
    """
    tip = is_tip(F.col("node"))

    def hashed(value: Column) -> Column:
        return F.when(tip, value.cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))

    values = {
        "n_tips": F.when(tip, 1).otherwise(0).cast("bigint"),
        "_h1": hashed(F.xxhash64("node")),
        "_h2": hashed(F.xxhash64(F.reverse("node"), F.lit(7))),
    }
    sums = subtree_sums(labels, values).where("n_tips > 0")
    return sums.select("node", "n_tips", F.concat_ws(":", "n_tips", F.col("_h1").cast("string"), F.col("_h2").cast("string")).alias("signature"))


def tips_below(labels: DataFrame) -> DataFrame:
    """(node, tip): each node with the tips below it, by a range test without a nested loop.

    Tips are numbered along the walk, so the tips of a node are a range. A range is laid out over blocks of 1, 2, 4, ...
    up to 4,096 tips, none twice; a tip is in one block of each size. Both meet by equality of the block.
    """
    tip = F.when(is_tip(F.col("node")), 1).otherwise(0).cast("bigint")
    before = stored(_before(labels, {"rank": tip}))
    low = before.select(F.col("at").alias("enter"), F.col("rank").alias("lo"))
    high = before.select(F.col("at").alias("leave"), F.col("rank").alias("hi"))
    placed = stored(labels.join(low, "enter").join(high, "leave").select("node", "lo", "hi"))
    blocks = [
        f"filter(array({', '.join(_odd_ends(level))}), b -> b IS NOT NULL)" for level in range(LEVELS)
    ]
    top = f"transform(sequence(1, greatest(({_floor('hi', LEVELS)}) - ({_ceil('lo', LEVELS)}), 0)), i -> struct({LEVELS} AS level, ({_ceil('lo', LEVELS)}) + i - 1 AS block))"
    some = f"filter({top}, b -> ({_floor('hi', LEVELS)}) > ({_ceil('lo', LEVELS)}))"
    ranges = placed.where("hi > lo").select("node", F.explode(F.expr(f"concat({', '.join(blocks)}, {some})")).alias("b")).select("node", "b.level", "b.block")
    tips = placed.where(is_tip(F.col("node"))).select(F.col("node").alias("tip"), "lo", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    tips = tips.select("tip", "level", F.expr("shiftright(lo, level)").alias("block"))
    return ranges.join(tips, ["level", "block"]).where("node <> tip").select("node", "tip")


def _floor(value: str, level: int) -> str:
    return f"shiftright({value}, {level})"


def _ceil(value: str, level: int) -> str:
    return f"shiftright({value} + {(1 << level) - 1}, {level})"


def _odd_ends(level: int) -> list[str]:
    """The block at either end of a range that does not fit into one of twice the size."""
    first, end = _ceil("lo", level), _floor("hi", level)
    return [
        f"CASE WHEN {first} < {end} AND {first} % 2 = 1 THEN struct({level} AS level, {first} AS block) END",
        f"CASE WHEN {first} < {end} AND {end} % 2 = 1 THEN struct({level} AS level, {end} - 1 AS block) END",
    ]
