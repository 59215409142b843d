"""Time series and spatial metrics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import correlation, name, number, numeric_columns, rounded
from ..functions.ranks import numbered


def lags(rows: DataFrame, keys: list[str], most: int, run: int = 100_000) -> DataFrame:
    """(keys, x, l1, ..., lmost) of rows (keys, _time, _tie, x): the values 1 to `most` rows before, in the order of _time and _tie.

    Without keys the rows are numbered by a range sort and dealt in runs of `run` (at least `most`) rows, each with the
    last `most` rows of the run before it, so no task gets the whole series.
    """
    before = lambda w: [F.lag("x", k).over(w).alias(f"l{k}") for k in range(1, most + 1)]
    if keys:
        return rows.select(*keys, "x", *before(Window.partitionBy(*keys).orderBy("_time", "_tie")))
    placed = numbered(rows, ["_time", "_tie"], "_n").select("x", "_n", F.expr(f"_n div {run}").alias("_run"), F.lit(True).alias("_own"))
    tails = placed.where(F.col("_n") % run >= run - most).select("x", "_n", F.col("_run") + 1, F.lit(False))
    return placed.union(tails).select("x", *before(Window.partitionBy("_run").orderBy("_n")), "_own").where("_own").drop("_own")


def periodicity(df: DataFrame, time: str, column: str, tie: str, most: int = 20, partition: list[str] | None = None) -> DataFrame:
    """(periodicity): the largest autocorrelation over lags 1 to min(most, n / 2), at least 0; 0 for fewer than 30 values.
    With `partition`, one row for each series, and series are windows of their own."""
    keys = partition or []
    rows = df.select(*keys, name(time).alias("_time"), name(tie).alias("_tie"), number(df, column).alias("x")).where("x IS NOT NULL")
    means = rows.groupBy(*keys).agg(F.avg("x").alias("mu"))
    lagged = lags(rows, keys, most)
    lagged = lagged.join(means.withColumnsRenamed({k: f"_of_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]) if keys else lagged.crossJoin(F.broadcast(means))  # one row
    n = F.count(F.lit(1))
    spread = F.sum((F.col("x") - F.col("mu")) ** 2)
    acf = [F.when(F.lit(2 * k) <= n, F.try_divide(F.sum((F.col("x") - F.col("mu")) * (F.col(f"l{k}") - F.col("mu"))), F.nullif(spread, F.lit(0.0)))) for k in range(1, most + 1)]
    best = F.when(n < 30, 0.0).otherwise(F.coalesce(rounded(F.greatest(F.lit(0.0), *acf)), F.lit(0.0))).alias("periodicity")
    return lagged.groupBy(*keys).agg(best) if keys else lagged.agg(best)


# MacKinnon's response surface for the test with a constant, one variable: tau limits and polynomials.
_TAU_MIN, _TAU_MAX, _TAU_STAR = -18.83, 2.74, -1.61
_SMALL = [2.1659, 1.4412, 0.038269]
_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]


def unit_root_p(tau: float) -> float:
    """Approximate p-value of the Dickey-Fuller statistic with a constant."""
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    z = sum(c * tau**i for i, c in enumerate(_SMALL if tau <= _TAU_STAR else _LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def stationarity(df: DataFrame, time: str, column: str, tie: str, n_lags: int = 1) -> DataFrame:
    """(stationarity): 1 - p of the augmented Dickey-Fuller test with a fixed number of lags; 0.5 where it isn't defined.
    Sums of products of a few lag columns are all that reaches the driver."""
    rows = df.select(name(time).alias("_time"), name(tie).alias("_tie"), number(df, column).alias("x")).where("x IS NOT NULL")
    near = ["x", *[f"l{k}" for k in range(1, n_lags + 2)]]
    steps = [(F.col(p) - F.col(q)).alias("dy" if k == 0 else f"d{k}") for k, (p, q) in enumerate(zip(near[:-1], near[1:], strict=True))]
    d = lags(rows, [], n_lags + 1).select(F.col("l1").alias("level"), *steps).dropna()
    names = ["one", "level", *[f"d{k}" for k in range(1, n_lags + 1)], "dy"]
    d = d.withColumn("one", F.lit(1.0))
    got = d.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]).first()
    m = np.array([[got[f"{a}_{b}"] if f"{a}_{b}" in got.asDict() else got[f"{b}_{a}"] for b in names] for a in names], dtype=float)
    value = 0.5
    if np.isfinite(m).all() and m[0, 0] > len(names) + 2:
        try:
            inverse = np.linalg.inv(m[:-1, :-1])
            beta = inverse @ m[:-1, -1]
            rss = m[-1, -1] - beta @ m[:-1, -1]
            tau = beta[1] / math.sqrt(rss / (m[0, 0] - len(beta)) * inverse[1, 1])
            value = round(1 - unit_root_p(tau), 4)
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            value = 0.5
    return df.sparkSession.createDataFrame([(value,)], "stationarity double")


def time_column(df: DataFrame) -> str | None:
    """The first timestamp or date column."""
    return next((f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))), None)


def time_series_properties(df: DataFrame, time: str | None = None, tie: str | None = None, most: int = 3) -> DataFrame:
    """(is_time_series, stationarity_strength, periodicity_strength) of a table in the order of its time column, or of its first timestamp
    or date column if none is named; rows of one time by the tie column. The strengths are means over the first `most` numeric
    columns, which is what the surveyed tool reads; 0 without such a column, or without a time column, when it is no series."""
    found = time if time in df.columns else None if time else time_column(df)
    columns = numeric_columns(df)[:most] if found else []
    if not columns:
        return df.sparkSession.createDataFrame([(found is not None, 0.0, 0.0)], "is_time_series boolean, stationarity_strength double, periodicity_strength double")
    each = [stationarity(df, found, c, tie or found).crossJoin(periodicity(df, found, c, tie or found)) for c in columns]  # one row each
    return reduce(DataFrame.union, each).agg(F.lit(True).alias("is_time_series"), rounded(F.avg("stationarity")).alias("stationarity_strength"), rounded(F.avg("periodicity")).alias("periodicity_strength"))


def spatial_correlation(df: DataFrame, x: str, y: str, z: str, order: str | list[str], rows: int = 1000) -> DataFrame:
    """(spatial_correlation): minus the correlation of distance and difference in z over all pairs of the first `rows` rows with known
    cells, by the order columns and then the cells, so that only equal rows are tied; 0 for fewer than 50. `rows` is
    the surveyed tool's own limit, and bounds the pairs."""
    keys = [order] if isinstance(order, str) else order
    cells = df.select(*[name(k).alias(f"k{i}") for i, k in enumerate(keys)], number(df, x).alias("x"), number(df, y).alias("y"), number(df, z).alias("z")).dropna(subset=["x", "y", "z"])
    by = [*[f"k{i}" for i in range(len(keys))], "x", "y", "z"]
    first = cells.orderBy(*by).limit(rows)  # at most `rows` rows, so one task may number them
    known = first.withColumn("n", F.row_number().over(Window.orderBy(*by)))
    a, b = known.alias("a"), known.alias("b")
    pairs = a.join(F.broadcast(b), F.col("a.n") < F.col("b.n"))
    distance = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2)
    value = -correlation(distance, F.abs(F.col("a.z") - F.col("b.z")))
    n = known.agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(value.alias("v")).crossJoin(n).select(F.when(F.col("n") < 50, 0.0).otherwise(F.coalesce(rounded(F.col("v")), F.lit(0.0))).alias("spatial_correlation"))
