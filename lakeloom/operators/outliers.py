"""Outliers and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, column_table, name, number, numeric_columns, rounded, share, value, value_counts
from ..functions.quantiles import exact_quantiles


def _quartiles(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, int]]:
    counts = df.agg(F.lit(0), *[F.count(number(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: (*q, counts[f"n{i}"]) for i, (c, q) in enumerate(exact_quantiles(df, columns, [0.25, 0.75]).items())}


def column_outliers(df: DataFrame, threshold: float = 1.5) -> DataFrame:
    """(n_out, n) of each numeric column by the interquartile rule; columns of fewer than 4 values or without spread have
    none."""
    columns = numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "n_out long, n long")
    bounds = _quartiles(df, columns)

    def outside(c: str):
        a, b, n = bounds[c]
        if n < 4 or a is None or b == a:
            return F.lit(0).cast("long")
        x = number(df, c)
        return F.count_if((x < a - threshold * (b - a)) | (x > b + threshold * (b - a)))

    counts = df.agg(*[F.struct(outside(c).alias("n_out"), F.count(number(df, c)).alias("n")).alias(f"c{i}") for i, c in enumerate(columns)])
    return counts.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("r")).select("r.*")


def outlier_severity(df: DataFrame) -> DataFrame:
    """(mild_ratio, moderate_ratio, severe_ratio, no_outliers_ratio): shares of the numeric columns with outliers in under
    5 %, under 20 %, or more of their values, and with none. All 0 without numeric columns."""
    part = F.col("n_out") / F.col("n")
    grades = {"mild_ratio": (F.col("n_out") > 0) & (part < 0.05), "moderate_ratio": (part >= 0.05) & (part < 0.2), "severe_ratio": part >= 0.2, "no_outliers_ratio": F.col("n_out") == 0}
    return column_outliers(df).agg(*[share(c).alias(k) for k, c in grades.items()])


def outlier_summary(df: DataFrame, threshold: float = 1.5) -> DataFrame:
    """(outlier_column_share, n_outliers, mean_outlier_share) of column_outliers."""
    return column_outliers(df, threshold).agg(share(F.col("n_out") > 0).alias("outlier_column_share"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("n_outliers"), F.coalesce(rounded(F.avg(F.coalesce(F.try_divide(F.col("n_out").cast("double"), "n"), F.lit(0.0)))), F.lit(0.0)).alias("mean_outlier_share"))


def _limit(df: DataFrame, c: str, low, high, method: str) -> DataFrame:
    x = name(c)
    if method == "remove":
        return df.where((x >= low) & (x <= high))
    return df.withColumn(c, F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x))


def zscore_outliers(df: DataFrame, columns: list[str], threshold: float = 3.0, method: str = "clip") -> DataFrame:
    """Clip or remove values over `threshold` sample deviations from the mean. Columns in turn: later ones see what
    earlier ones changed. Removal drops missing values too; a column without spread is left alone."""

    def one(table: DataFrame, c: str) -> DataFrame:
        mean, std = table.agg(F.avg(number(table, c)), F.stddev_samp(number(table, c))).first()
        return _limit(table, c, mean - threshold * std, mean + threshold * std, method) if std else table

    return reduce(one, columns, df)


def iqr_outliers(df: DataFrame, columns: list[str], threshold: float = 1.5, method: str = "clip") -> DataFrame:
    """As zscore_outliers, beyond `threshold` interquartile ranges from the quartiles."""

    def one(table: DataFrame, c: str) -> DataFrame:
        a, b, _ = _quartiles(table, [c])[c]
        return _limit(table, c, a - threshold * (b - a), b + threshold * (b - a), method) if a is not None else table

    return reduce(one, columns, df)


def type_consistency(df: DataFrame) -> DataFrame:
    """(inconsistent_share): share of all columns that are text with both numbers and other values in them."""
    texts = categorical_columns(df)
    kinds = column_table(df, texts, numbers=lambda c: F.count_if(c.try_cast("double").isNotNull()), others=lambda c: F.count_if(c.isNotNull() & c.try_cast("double").isNull()))
    return kinds.agg(rounded(F.count_if((F.col("numbers") > 0) & (F.col("others") > 0)) / F.lit(float(max(1, len(df.columns))))).alias("inconsistent_share"))


def uniqueness_violations(df: DataFrame) -> DataFrame:
    """(checked, violations): columns with id, key or code in their name, or else all, and those of them that repeat a value."""
    columns = [c for c in df.columns if any(k in c.lower() for k in ("id", "key", "code"))] or df.columns
    repeated = value_counts(df, columns).groupBy("column").agg((F.max("cnt") > 1).alias("bad"))
    return repeated.agg(F.lit(len(columns)).alias("checked"), F.count_if("bad").alias("violations"))


def null_or_nan(df: DataFrame, c: str):
    return value(df, c).isNull()
