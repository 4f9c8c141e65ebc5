"""Keys, ranks, first-per-key and top rows without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baseloom.session import stored


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """The rows, written once, sorted inside key ranges, with ``_range`` and the place ``_range_at`` inside it (from 0).

    The range partitioner deals the rows by the bounds it samples, so the cost
    of a row does not grow with the number of ranges. Range and place are
    written with the row: all later steps, and the rerun of a lost task, read
    the same ranges.
    """
    sorted_rows = df.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
    # The id is the partition's number above 33 bits of the row's place in it.
    numbered = stored(sorted_rows.withColumn("_range_id", F.monotonically_increasing_id()))
    return numbered.select(
        *df.columns, F.shiftright("_range_id", 33).alias("_range"), F.col("_range_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_range_at")
    )


def _offsets(ranged: DataFrame, size: Column) -> DataFrame:
    """Sum of ``size`` over the ranges before each range: one row per range, so bounded by their number."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(size.alias("_total"))
    return totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_range_offset"))


def assign_pk(df: DataFrame, order: list[str], pk: str, start: int = 1, buckets: int | None = None) -> DataFrame:
    """Consecutive numbers in the order of ``order`` (which must be a key).

    One range shuffle carries the rows; the ranges' counts (one row per range)
    give the offsets. No task sees more than its range, and no window is
    needed: a row's place in its range is written with it.
    """
    ranged = _ranged(df, order, buckets or _buckets(df))
    # At most one row per range, so the broadcast is bounded by `buckets`.
    return (
        ranged.join(F.broadcast(_offsets(ranged, F.count(F.lit(1)))), "_range")
        .withColumn(pk, (F.col("_range_offset") + F.col("_range_at") + start).cast("bigint"))
        .drop("_range", "_range_at", "_range_offset")
    )


def running_total(df: DataFrame, order: list[str], value: str, name: str, buckets: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows before each row, in the order of ``order``."""
    ranged = _ranged(df, order, buckets or _buckets(df))
    inside = Window.partitionBy("_range").orderBy("_range_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(_offsets(ranged, F.sum(value))), "_range")
        .withColumn(name, F.col("_range_offset") + F.col("_inside"))
        .drop("_range", "_range_at", "_inside", "_range_offset")
    )


def dense_rank_desc(df: DataFrame, value: str, name: str) -> DataFrame:
    """Dense rank, largest first: ranks the distinct values and joins them back."""
    distinct = df.where(F.col(value).isNotNull()).select((-F.col(value)).alias("_neg")).distinct()
    ranks = assign_pk(distinct, ["_neg"], name).select((-F.col("_neg")).alias(value), name)
    return df.join(ranks, value, "left")


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``; remaining columns break ties.

    An aggregate, so a hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    tail = [c for c in order if c not in keys]
    best = F.min(F.struct(*tail, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    tail = [c for c in order if c not in keys]
    best = F.max(F.struct(*tail, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def first_value(col: Column, order: Column) -> Column:
    """Aggregate: the first non-NULL value by order."""
    return F.min(F.when(col.isNotNull(), F.struct(order.alias("o"), col.alias("v")))).getField("v")


def collapse_first(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Per key and column the first non-NULL value in source order."""
    return df.groupBy(*keys).agg(*[first_value(F.col(c), F.col(order)).alias(c) for c in columns])


def limit_per_group(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows per key.

    Each hash part of a group keeps its own first ``n``, so the last window sees
    at most ``n`` rows per part and key, however large the group is.
    """
    parted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(_buckets(df))))
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        parted.withColumn("_rank", F.row_number().over(local))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final))
        .where(F.col("_rank") <= n)
        .drop("_rank", "_part")
    )


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def preview(df: DataFrame, order: list[str], n: int = 25) -> DataFrame:
    """The first rows, each with the number of rows not shown."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(n).withColumn("n_more", F.greatest(total - F.lit(n), F.lit(0)).cast("bigint"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Seeded sample of ``n`` rows: the smallest hashes of the key."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(f":{seed}"))), F.col(key)).limit(n)


def _value_bin(value: Column) -> Column:
    """A bin number that grows with the value, about 0.1 % of it wide.

    It depends on the value alone, so no group's range has to be known first.
    """
    size = F.floor(F.log(F.abs(value)) * 1024).cast("bigint") + 1_000_000
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, as one column per name.

    Equal values of a group are counted first (combined before the shuffle), so
    a value that most rows have is one row from there on. Sums per bin find the
    bins that hold a wanted rank; only the values of these bins are ranked. A
    group that holds most of the rows is spread over its values, and nothing is
    sampled.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_bin", _value_bin(F.col("_v")))
    values = rows.groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_n"))
    per_bin = values.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in_bin"))
    # From here on one row per group and bin, whatever the size of the group.
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = [f"(_total - 1) * {float(p)!r}D" for p in probs.values()]
    ranks = ", ".join(f"bigint(floor({x})), bigint(ceil({x}))" for x in places)
    targets = (
        per_bin.select(
            *keys, "_bin", "_in_bin", F.sum("_in_bin").over(upto).alias("_upto"), F.sum("_in_bin").over(group).alias("_total")
        )
        .where(f"exists(array({ranks}), r -> r >= _upto - _in_bin AND r < _upto)")
        .select(*keys, "_bin", F.expr("_upto - _in_bin").alias("_before"), "_total")
    )
    counted = values.join(targets, [*keys, "_bin"])
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = counted.select(*keys, "_total", "_v", "_n", (F.col("_before") + F.sum("_n").over(inside)).alias("_end"))
    hits = ranked.select(
        *keys,
        "_total",
        "_v",
        F.expr(f"explode(filter(array_distinct(array({ranks})), r -> r >= _end - _n AND r < _end))").alias("_rank"),
    )
    ends = [
        F.expr(f"max(CASE WHEN _rank = bigint({side}({x})) THEN _v END)").alias(f"_{name}_{side}")
        for name, x in zip(probs, places)
        for side in ("floor", "ceil")
    ]
    picked = hits.groupBy(*keys, "_total").agg(*ends)
    return picked.select(
        *keys,
        *[
            F.expr(f"_{n}_floor * (1 - ({x} - floor({x}))) + _{n}_ceil * ({x} - floor({x}))").alias(n)
            for n, x in zip(probs, places)
        ],
    )
