"""Which columns are numeric, what counts as missing, and shared one-pass intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def name(c: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(f"`{c.replace('`', '``')}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def value(df: DataFrame, c: str) -> Column:
    """The column with NaN as null."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(name(c)), name(c))
    return name(c)


def number(df: DataFrame, c: str) -> Column:
    """The column as a double, NaN as null."""
    return value(df, c).cast("double")


def long_form(df: DataFrame, columns: list[str], kind: str, with_nulls: bool = True) -> DataFrame:
    """(column, value) rows of the columns, values cast to one type. One pass over the table; no column is read twice."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(df, c).cast(kind).alias("value")) for c in columns])
    out = df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value")
    return out if with_nulls else out.where("value IS NOT NULL")


def value_counts(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    """(column, value, cnt) of the non-null values."""
    return long_form(df, columns, kind, with_nulls=False).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def column_table(df: DataFrame, columns: list[str], **aggregates) -> DataFrame:
    """One row for each column: (position, column, an aggregate each). aggregates: name -> function of the column's
    expression. One wide aggregation over the table, then one row is turned into many."""
    if not columns:
        fields = [F.lit(0).alias("position"), F.lit("").alias("column")]
        return df.agg(*[f(F.lit(None).cast("double")).alias(k) for k, f in aggregates.items()]).select(*fields, *aggregates).where("false")
    wide = df.agg(*[f(value(df, c)).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, f in aggregates.items()])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), *[F.col(f"{i}_{k}").alias(k) for k in aggregates]) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def share(condition: Column) -> Column:
    """Share of rows that satisfy the condition, to four decimals; 0 without rows."""
    return F.coalesce(F.bround(F.try_divide(F.count_if(condition), F.count(F.lit(1)).cast("double")), 4), F.lit(0.0))


def rounded(c: Column, digits: int = 4) -> Column:
    return F.bround(c, digits)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are known, from moment sums; null if one is constant there."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    cov = F.covar_pop(a, b)
    return F.try_divide(cov, F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def even(x: Column, digits: int) -> Column:
    """bround of a double, by its decimal digits only where it is close to a tie or large: for expressions over many rows."""
    scaled = x * float(10**digits)
    clear = (F.abs(scaled) < 1e6) & (F.abs(F.abs(scaled - F.floor(scaled)) - 0.5) > 1e-6)
    return F.when(clear, F.rint(scaled) / float(10**digits) + 0.0).otherwise(F.bround(x, digits))
