"""Distribution metrics: one row each, from column statistics or value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, column_table, number, numeric_columns, rounded, share, value, value_counts


def skewness_profile(df: DataFrame) -> DataFrame:
    """Shares of numeric columns by population skewness g: (high_share |g| > 1, right_share > 0.5, left_share < -0.5,
    symmetric_share). Fewer than 3 values count as 0; a constant column is in no class."""
    g = column_table(df, numeric_columns(df), n=F.count, g=lambda c: F.skewness(c.cast("double"))).select(F.when(F.col("n") < 3, 0.0).otherwise(F.col("g")).alias("g"))
    return g.agg(share(F.abs("g") > 1).alias("high_share"), share(F.col("g") > 0.5).alias("right_share"), share(F.col("g") < -0.5).alias("left_share"), share(F.abs("g") <= 0.5).alias("symmetric_share"))


def scale_profile(df: DataFrame, wide: float = 1000) -> DataFrame:
    """(wide_share of numeric columns whose range is over `wide`, has_positive, has_negative); columns of fewer than two values are left out."""
    stats = column_table(df, numeric_columns(df), n=F.count, lo=lambda c: F.min(c.cast("double")), hi=lambda c: F.max(c.cast("double"))).where("n >= 2")
    return stats.agg(share(F.col("hi") - F.col("lo") > wide).alias("wide_share"), F.coalesce(F.bool_or(F.col("hi") > 0), F.lit(False)).alias("has_positive"), F.coalesce(F.bool_or(F.col("lo") < 0), F.lit(False)).alias("has_negative"))


def normality(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(normal_share): share of numeric columns that D'Agostino and Pearson's K2 test doesn't reject. Columns of fewer
    than 8 values, or constant ones, aren't counted as normal."""
    stats = column_table(df, numeric_columns(df), n=F.count, g1=lambda c: F.skewness(c.cast("double")), g2=lambda c: F.kurtosis(c.cast("double")))
    n, b1, g2 = F.col("n").cast("double"), F.col("g1"), F.col("g2")
    # skewness test: transformed g1 is about standard normal
    y = b1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(F.sqrt(w2)))
    # kurtosis test: the same by a cube root
    mean = -6 / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 - mean) / F.sqrt(var)
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + F.sqrt(1 + 4 / (skew * skew)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    tested = stats.where("n >= 8").withColumn("p", F.exp(-(z1 * z1 + z2 * z2) / 2))
    total = max(1, len(numeric_columns(df)))
    return tested.agg(rounded(F.count_if(F.col("p") > alpha) / F.lit(float(total))).alias("normal_share"))


def multimodality(df: DataFrame, points: int = 200, prominence: float = 0.1) -> DataFrame:
    """(multimodal_share): share of numeric columns whose smoothed density has over one peak of at least `prominence` of
    the largest. Values are counted in `points` bins of the column's range; the bins are smoothed by a Gaussian of
    Scott's bandwidth. Columns of fewer than 20 values, or without spread, have one peak."""
    columns = numeric_columns(df)
    stats = column_table(df, columns, n=F.count, lo=lambda c: F.min(c.cast("double")), hi=lambda c: F.max(c.cast("double")), sd=lambda c: F.stddev_samp(c.cast("double")))
    usable = stats.where("n >= 20 AND sd > 0")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(df, c).alias("x")) for c in columns])
    width = (F.col("hi") - F.col("lo")) / points
    binned = (
        df.select(F.explode(cells).alias("r")).select("r.*").where("x IS NOT NULL").join(F.broadcast(usable), "column")
        .groupBy("column", F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(points - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"), F.first("n").alias("n"), F.first("sd").alias("sd"), F.first(width).alias("width"))
    )
    grid = binned.select("column").distinct().select("column", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("at"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), -0.2)
    density = grid.join(binned, "column").groupBy("column", "at").agg(F.sum(F.col("cnt") * F.exp(-0.5 * F.pow((F.col("at") - F.col("bin")) * F.col("width") / h, 2))).alias("d"))  # at most points**2 for a column
    w = Window.partitionBy("column").orderBy("at")
    marked = density.withColumn("up", (F.col("d") > F.coalesce(F.lag("d").over(w), F.lit(0.0))) & (F.col("d") >= F.coalesce(F.lead("d").over(w), F.lit(0.0)))).withColumn("top", F.max("d").over(Window.partitionBy("column")))
    # a peak stands out if, on one side, the density falls by the prominence before it meets a higher point
    peaks = marked.where("up").select("column", F.col("at").alias("p"), F.col("d").alias("pd"), "top")
    seen = peaks.join(density, "column")
    higher_left, higher_right = F.max(F.when((F.col("at") < F.col("p")) & (F.col("d") > F.col("pd")), F.col("at"))), F.min(F.when((F.col("at") > F.col("p")) & (F.col("d") > F.col("pd")), F.col("at")))
    walls = seen.groupBy("column", "p", "pd", "top").agg(higher_left.alias("l"), higher_right.alias("r"))
    dips = walls.join(density, "column").groupBy("column", "p", "pd", "top").agg(
        F.min(F.when((F.col("at") <= F.col("p")) & (F.col("at") >= F.coalesce("l", F.lit(-1))), F.col("d"))).alias("dl"),
        F.min(F.when((F.col("at") >= F.col("p")) & (F.col("at") <= F.coalesce("r", F.lit(points))), F.col("d"))).alias("dr"),
    )
    many = dips.where(F.col("pd") - F.greatest("dl", "dr") >= prominence * F.col("top")).groupBy("column").count().where("count > 1")
    return many.agg(rounded(F.count(F.lit(1)) / F.lit(float(max(1, len(columns))))).alias("multimodal_share"))


def _distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    return column_table(df, columns, n=F.count, n_distinct=F.count_distinct)


def cardinality_profile(df: DataFrame, low: int = 10, high: int = 100) -> DataFrame:
    """(low_share, high_share) of categorical columns with at most `low`, or over `high`, distinct values."""
    return _distinct(df, categorical_columns(df)).agg(share(F.col("n_distinct") <= low).alias("low_share"), share(F.col("n_distinct") > high).alias("high_share"))


def imbalance_profile(df: DataFrame) -> DataFrame:
    """(balanced_share, moderate_share, severe_share) of categorical columns by the share of their most frequent value:
    under 0.7, under 0.9, or more. An empty column is balanced."""
    columns = categorical_columns(df)
    top = value_counts(df, columns).groupBy("column").agg((F.max("cnt") / F.sum("cnt")).alias("top"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    both = names.join(top, "column", "left").select(F.coalesce("top", F.lit(0.0)).alias("top"))
    return both.agg(share(F.col("top") < 0.7).alias("balanced_share"), share((F.col("top") >= 0.7) & (F.col("top") < 0.9)).alias("moderate_share"), share(F.col("top") >= 0.9).alias("severe_share"))


def rare_categories(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(rare_column_share, mean_rare_mass): categorical columns with a value under the threshold, and what such values hold there."""
    columns = categorical_columns(df)
    counts = value_counts(df, columns)
    shares = counts.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("column"))).where(F.col("p") < threshold)
    mass = shares.groupBy("column").agg(F.sum("p").alias("mass"))
    return mass.agg(rounded(F.count(F.lit(1)) / F.lit(float(max(1, len(columns))))).alias("rare_column_share"), F.coalesce(rounded(F.avg("mass")), F.lit(0.0)).alias("mean_rare_mass"))


def cardinality_distribution(df: DataFrame) -> DataFrame:
    """(shape, long_tail): of the distinct counts of categorical columns and of numeric ones with at most 20 distinct
    values. power_law: Gini over 0.6; uniform: deviation under half the mean; else normal_like; unknown under 5 columns.
    long_tail: share of the columns over mean + 2 deviations."""
    numeric = numeric_columns(df)
    counts = _distinct(df, categorical_columns(df)).select("n_distinct").union(_distinct(df, numeric).where("n_distinct <= 20").select("n_distinct"))
    ranked = counts.withColumn("i", F.row_number().over(Window.orderBy("n_distinct"))).withColumn("x", F.col("n_distinct").cast("double"))  # a row for each column
    n, total = F.count(F.lit(1)), F.sum("x")
    stats = ranked.agg(n.alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), (F.try_divide(2 * F.sum(F.col("i") * F.col("x")), n * total) - 1).alias("gini"))
    tail = ranked.crossJoin(stats).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.first("gini").alias("gini"), share(F.col("x") > F.col("mean") + 2 * F.col("sd")).alias("long_tail"))
    shape = F.when(F.coalesce("n", F.lit(0)) < 5, "unknown").when(F.col("gini") > 0.6, "power_law").when(F.col("sd") < 0.5 * F.col("mean"), "uniform").otherwise("normal_like")
    return tail.select(shape.alias("shape"), "long_tail")


def samples_per_feature(df: DataFrame, target: str | None = None) -> DataFrame:
    """(samples_per_feature): rows with any value over columns with any value, the target left out."""
    columns = [c for c in df.columns if c != target]
    any_value = F.coalesce(*[value(df, c).cast("string") for c in columns]).isNotNull()
    used = sum((F.when(F.count(value(df, c)) > 0, 1).otherwise(0) for c in columns), F.lit(0))
    return df.agg(F.coalesce(rounded(F.try_divide(F.count_if(any_value).cast("double"), used)), F.lit(0.0)).alias("samples_per_feature"))


def sparsity(df: DataFrame) -> DataFrame:
    """(zero_dominated_share, sparse_share) of all columns: numeric ones with at least 90 % zeros among their values;
    columns whose non-zero, non-blank values are at most 10 % of all rows. A column without values is neither."""
    numeric = set(numeric_columns(df))

    def filled(c: str):
        x = value(df, c)
        return F.count_if(x != 0) if c in numeric else F.count_if(F.trim(x.cast("string")) != "")

    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.struct(F.count(value(df, c)).alias("n"), (F.count_if(value(df, c) == 0) if c in numeric else F.lit(0).cast("long")).alias("zeros"), filled(c).alias("filled")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = wide.select("rows", F.explode(F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])).alias("r")).select("rows", "r.*")
    return rows.agg(share((F.col("n") > 0) & (F.col("zeros") >= 0.9 * F.col("n"))).alias("zero_dominated_share"), share((F.col("n") > 0) & (F.col("filled") <= 0.1 * F.col("rows"))).alias("sparse_share"))


def uncertainty(df: DataFrame, target: str | None = None) -> DataFrame:
    """(uncertainty): entropy of the target over its largest possible value. A numeric target is cut into min(10, n // 5)
    right-closed bins of equal width; fewer than 5 values give 0.5. Without a target, or one that is no column: the mean share of distinct
    values of the first ten columns with at least 5 values, which are what the surveyed tool reads; 0.5 without any. No row at all gives 0.1."""
    if target is None or target not in df.columns:
        columns = df.columns[:10]
        wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.struct(F.count(value(df, c)).alias("n"), F.count_distinct(value(df, c)).alias("d")).alias(f"c{i}") for i, c in enumerate(columns)])
        each = wide.select("rows", F.explode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("r")).select("rows", "r.*")
        mean = F.coalesce(rounded(F.avg(F.when(F.col("n") >= 5, F.col("d") / F.col("n")))), F.lit(0.5))
        return each.agg(F.when(F.max("rows") == 0, 0.1).otherwise(mean).alias("uncertainty"))
    x = value(df, target)
    if target in numeric_columns(df):
        stats = df.agg(F.count(x).alias("n"), F.min(x.cast("double")).alias("lo"), F.max(x.cast("double")).alias("hi"))
        bins = F.least(F.lit(10), F.floor(F.col("n") / 5))
        place = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(1), F.ceil((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))).otherwise(1)
        keyed = df.select(x.cast("double").alias("x")).where("x IS NOT NULL").crossJoin(F.broadcast(stats)).select(place.alias("k"))
    else:
        keyed = df.select(x.alias("k")).where("k IS NOT NULL")
    p = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("cnt"))
    total = p.agg(F.sum("cnt").alias("total"))
    q = F.col("cnt") / F.col("total")
    return p.crossJoin(F.broadcast(total)).agg(F.when(F.coalesce(F.max("total"), F.lit(0)) < 5, 0.5).otherwise(F.coalesce(rounded(F.try_divide(-F.sum(q * F.log2(q)), F.nullif(F.log2(F.count(F.lit(1)).cast("double")), F.lit(0.0)))), F.lit(0.0))).alias("uncertainty"))
