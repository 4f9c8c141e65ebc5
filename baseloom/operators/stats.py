"""Distribution summaries, correlations, regressions and model tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from baseloom.operators.ranking import exact_quantiles
from baseloom.session import stored

_QUANTILES = {"median": 0.5, "q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95}


def distribution(
    df: DataFrame,
    keys: list[str],
    metrics: dict[str, tuple[str, str | None]],
    single_spread: float | None = None,
) -> DataFrame:
    """Summary statistics per key and metric, in long form.

    ``metrics`` maps a metric name to its value column and weight column.
    NULL values are left out; weights that are NULL or not positive do not
    count in the weighted mean. ``single_spread`` is the spread of one value.
    """
    long = _long_form(df, keys, metrics)
    by = [*keys, "metric"]
    weight = F.when(F.col("w") > 0, F.col("w"))
    n = F.count("v")
    spread = F.when(n > 1, F.var_samp("v")).when(n == 1, F.lit(single_spread).cast("double"))
    base = long.groupBy(*by).agg(
        n.alias("n"),
        F.avg("v").alias("mean"),
        (F.sum(F.col("v") * weight) / F.sum(weight)).alias("weighted_mean"),
        spread.alias("var"),
    )
    # One row per key and metric, read by three later steps: written once.
    quantiles = stored(exact_quantiles(long, by, "v", _QUANTILES))
    centred = long.join(quantiles.select(*by, "median"), by).select(*by, F.abs(F.col("v") - F.col("median")).alias("v"))
    mad = exact_quantiles(centred, by, "v", {"mad": 0.5})
    return (
        base.join(quantiles, by)
        .join(mad, by)
        .withColumn("sd", F.sqrt("var"))
        .withColumn("iqr", F.col("q75") - F.col("q25"))
    )


def _long_form(df: DataFrame, keys: list[str], metrics: dict[str, tuple[str, str | None]]) -> DataFrame:
    items = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(value).cast("double").alias("v"),
            (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"),
        )
        for name, (value, weight) in metrics.items()
    ]
    return df.select(*keys, F.inline(F.array(*items))).where(F.col("v").isNotNull() & ~F.isnan("v"))


def widen(long: DataFrame, keys: list[str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Long statistics to columns; ``wanted`` maps column to (metric, statistic)."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(s))).alias(c) for c, (m, s) in wanted.items()]
    )


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL and non-NULL counts per column, in one pass."""
    counted = df.agg(
        *[
            F.struct(
                F.lit(c).alias("variable"),
                F.count_if(F.col(c).isNull()).alias("n_missing"),
                F.count(F.col(c)).alias("n_present"),
            ).alias(c)
            for c in columns
        ]
    )
    return counted.select(F.inline(F.array(*[F.col(c) for c in columns])))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair, over rows where both are present."""
    pairs = [(a, b) for a in columns for b in columns]
    both = {
        (a, b): F.corr(*[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(x).cast("double")) for x in (a, b)])
        for a, b in pairs
    }
    counted = df.agg(*[c.alias(f"{a}__{b}") for (a, b), c in both.items()])
    rows = [
        F.struct(F.lit(a).alias("variable"), *[F.col(f"{a}__{b}").alias(b) for b in columns]) for a in columns
    ]
    return counted.select(F.inline(F.array(*rows)))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation factors over complete rows.

    One distributed pass gives the correlations; the inverse of that k by k
    matrix (k the number of columns) is taken on the driver.
    """
    complete = df.dropna(subset=columns)
    matrix = correlations(complete, columns).collect()
    at = {r["variable"]: r for r in matrix}
    values = np.array([[at[a][b] if at[a][b] is not None else math.nan for b in columns] for a in columns], dtype=float)
    inverse = np.linalg.pinv(values) if np.isfinite(values).all() else np.full(values.shape, np.nan)
    rows = [(c, float(inverse[i, i])) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "variable string, vif double")


def ols_by(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x per key, with the slope's two-sided p-value."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    fits = df.groupBy(*keys).agg(
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_r2(ys, xs).alias("r_squared"),
        F.regr_count(ys, xs).alias("n"),
    )
    freedom = F.col("n") - 2
    t = F.sqrt(F.col("r_squared") * freedom / (1 - F.col("r_squared")))
    return fits.withColumn("t_abs", F.when((freedom > 0) & (F.col("r_squared") < 1), t)).withColumn(
        "p_value", _t_tail(F.col("t_abs"), freedom.cast("double"))
    )


@F.pandas_udf(DoubleType())
def _t_tail(t: pd.Series, freedom: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t on the fitted rows (one row per key)."""
    return pd.Series(
        [None if pd.isna(a) or pd.isna(f) or f <= 0 else _beta_fraction(f / (f + a * a), f / 2.0, 0.5) for a, f in zip(t, freedom)],
        dtype="float64",
    )


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_fraction(1 - x, b, a)
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return scale * total / a


def model_ranking(fits: DataFrame) -> DataFrame:
    """AICc, its difference to the best, and Akaike weights.

    ``fits`` has ``model, n, k, aic``; the best AICc and the weights' sum are
    scalar aggregates, so no row leaves its task. Rows that are too few for a
    model get a note instead.
    """
    room = F.col("n") - F.col("k") - 1
    ranked = fits.withColumn(
        "aicc", F.when(room > 0, F.col("aic") + 2 * F.col("k") * (F.col("k") + 1) / room)
    )
    delta = F.col("aicc") - ranked.agg(F.min("aicc")).scalar()
    weighted = ranked.withColumn("delta_aicc", delta)
    weighted = weighted.withColumn("_w", F.exp(-0.5 * F.col("delta_aicc")))
    return (
        weighted.withColumn("weight_aicc", F.col("_w") / weighted.agg(F.sum("_w")).scalar())
        .withColumn("note", F.when(room > 0, F.lit("fit")).otherwise(F.lit("skipped_too_few_complete_rows")))
        .drop("_w")
    )


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, spread and range of numeric columns."""
    items = [
        F.struct(
            F.lit(c).alias("variable"),
            F.count(F.col(c)).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("sd"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
        ).alias(c)
        for c in columns
    ]
    counted = df.agg(*items)
    return counted.select(F.inline(F.array(*[F.col(c) for c in columns])))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value, NULL included."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def positive_log10(col: Column) -> Column:
    return F.when(col > 0, F.log10(col))
