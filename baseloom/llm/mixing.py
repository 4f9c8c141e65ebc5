"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words by weight; targets above the largest number of repeats are cut there and the
excess goes to the others by weight. A source's target is first met by whole copies of all its documents; the
rest is a fixed-size sample in words: documents are ranked by the odds of a uniform number over the odds of
their inclusion probability (Pareto order sampling), and taken from the smallest rank until the rest is reached.
The last document is taken if that brings the total nearer.

No source is gathered: word sums per rank bin locate the cut in two steps of 1024 bins, and only rows of one
bin in a million are ranked exactly. Uniform numbers come from a hash of seed and id, so reruns agree.

Defined cases: a null text or a text without words has size 0; such documents get the whole copies and never
the sampled one. A null source is a source of its own, last in order. Rows with equal id, source and size are taken or left
together. A null id is hashed as an empty text. An empty table gives an empty result; a source without words has target 0.
Input columns with the names of result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baseloom.llm.registry import WORD, query, staged, table

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
SEED = "mix"
BINS = 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from 52 bits of a hash."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source from (source, size): its size, target, whole copies, and the chance of one more.

    The cut targets are found at once: in the order of size over weight, a source is cut exactly if its bound
    lies below the level that all words not yet bound would reach on the weights left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("bound", most * F.col("source_size"))
    fill = Window.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    words = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(fill), F.lit(0))
    per = per.withColumn("level", words / left).withColumn("level", F.max("level").over(whole))
    per = per.withColumn("target", F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight")))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return per.select(
        "source",
        "source_size",
        "target",
        copies.cast("long").alias("whole"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - copies).otherwise(0.0).alias("chance"),
        (F.col("target") - copies * F.col("source_size")).alias("rest"),
    )


def _rank(u: Column, chance: Column) -> Column:
    """Odds of the uniform number over odds of inclusion, brought to 0..1 in the same order."""
    odds = (u / (1 - u)) / (chance / (1 - chance))
    return odds / (1 + odds)


def _bin1(rank: Column) -> Column:
    return F.least(F.floor(rank * BINS), F.lit(BINS - 1)).cast("int")


def _bin2(rank: Column) -> Column:
    return F.least(F.floor((rank * BINS - F.floor(rank * BINS)) * BINS), F.lit(BINS - 1)).cast("int")


def _first_over(rows: DataFrame, bin_: str) -> DataFrame:
    """Per source the first bin whose running sum of words reaches the rest, and the words before it."""
    order = Window.partitionBy("source").orderBy(bin_)
    sums = rows.groupBy("source", "rest", "before", bin_).agg(F.sum("size").alias("n"))
    run = F.col("before") + F.sum("n").over(order)
    sums = sums.withColumn("until", run)
    return (
        sums.where("until >= rest")
        .groupBy("source")
        .agg(F.min(F.struct(F.col(bin_).alias("bin"), (F.col("until") - F.col("n")).alias("before"))).alias("f"))
        .select(F.col("source").alias("s"), F.col("f.bin").alias(f"cut_{bin_}"), F.col("f.before").alias("at"))
    )


def plan(documents: DataFrame, weights=WEIGHTS, share=TOTAL_SHARE, most=MOST_COPIES, seed=SEED) -> DataFrame:
    """One row per source: targets, and where its sample ends in rank order."""
    sizes = staged(documents.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    per = staged(targets(sizes, weights, share, most), "targets")
    chosen = per.where("chance > 0").withColumnRenamed("source", "p")
    rank = _rank(uniform(F.col("doc_id"), seed), F.col("chance"))
    ranked = (
        sizes.where("size > 0")
        .join(chosen.select("p", "chance", "rest"), F.col("source").eqNullSafe(F.col("p")))
        .drop("p")
        .withColumn("rank", rank)
        .withColumns({"b1": _bin1(F.col("rank")), "b2": _bin2(F.col("rank")), "before": F.lit(0).cast("long")})
    )
    first = _first_over(ranked, "b1")
    inside = ranked.drop("before").join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("b1") == F.col("cut_b1"))).withColumn("before", F.col("at")).drop("s", "at")
    second = _first_over(inside, "b2")
    last = inside.drop("before").join(second, F.col("source").eqNullSafe(F.col("s")) & (F.col("b2") == F.col("cut_b2"))).drop("s")
    ties = last.groupBy("source", "cut_b1", "cut_b2", "rest", "at", "rank", "doc_id", "size").agg((F.sum("size")).alias("n"))
    run = F.col("at") + F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = ties.withColumn("run", run).withColumn("taken", 2 * F.col("run") + F.col("n") <= 2 * F.col("rest"))
    cuts = taken.groupBy("source", "cut_b1", "cut_b2").agg(F.max(F.when(F.col("taken"), F.struct("rank", "doc_id", "size"))).alias("cut"))
    return per.join(cuts.withColumnRenamed("source", "c"), F.col("source").eqNullSafe(F.col("c")), "left").drop("c")


def mix(documents: DataFrame, plan_: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents with size, source_size, target and copies (0 to the largest number of repeats)."""
    own = ("size", "source_size", "target", "copies", "taken")
    per = plan_.select(*[F.col(c).alias(f"__{c}") for c in plan_.columns])
    docs = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in own], size_of(F.col("text")).alias("size"))
    rank = _rank(uniform(F.col("doc_id"), seed), F.col("__chance"))
    b1, b2 = _bin1(rank), _bin2(rank)
    after = F.col("__cut_b1").isNull()
    sampled = (
        after
        | (b1 < F.col("__cut_b1"))
        | ((b1 == F.col("__cut_b1")) & (b2 < F.col("__cut_b2")))
        | (
            (b1 == F.col("__cut_b1"))
            & (b2 == F.col("__cut_b2"))
            & F.coalesce(F.struct(rank.alias("rank"), "doc_id", "size") <= F.col("__cut"), F.lit(False))
        )
    )
    extra = F.when((F.col("__chance") > 0) & (F.col("size") > 0), sampled.cast("long")).otherwise(0)
    return (
        docs.join(per, F.col("source").eqNullSafe(F.col("__source")))
        .withColumns({"source_size": F.col("__source_size"), "target": F.col("__target"), "copies": F.col("__whole") + extra})
        .drop(*per.columns)
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS bound FROM s),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(bound) OVER f, 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS DOUBLE) AS lev FROM w
  WINDOW f AS (ORDER BY CAST(bound AS DOUBLE) / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(CAST(bound AS DOUBLE), max(lev) OVER () * weight) AS target FROM l),
p AS MATERIALIZED (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0.0::DOUBLE END AS chance,
  target - CAST(whole * source_size AS DOUBLE) AS rest FROM p),
r AS (SELECT d.*, q.source_size, q.target, q.whole, q.chance, q.rest, (u / (1 - u)) / (chance / (1 - chance)) AS odds
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
g AS (SELECT *, odds / (1 + odds) AS rank FROM r),
c AS (SELECT *, sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size) AS until,
  sum(size) OVER (PARTITION BY source, rank, doc_id, size) AS n FROM g)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN chance > 0 AND size > 0 AND 2 * (until - n) + n <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c"""


@query("op3_mixing", _SQL)
def op3_mixing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return mix(docs, plan(docs)).select("doc_id", "size", "source_size", "target", "taken")
