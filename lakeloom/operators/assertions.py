"""Data-quality assertions: rows (check, subject, passed, detail)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import name, value


def _row(check: str, subject: Column | str, passed: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"), passed.alias("passed"), detail.cast("string").alias("detail")]


def required_tables(required: DataFrame, tables: DataFrame) -> DataFrame:
    """A row for each case of required(case, table_name): passes if none is missing in tables(case, table_name)."""
    lacking = required.join(tables, ["case", "table_name"], "left_anti").groupBy("case").agg(F.array_join(F.sort_array(F.collect_set("table_name")), ",").alias("names"))
    return required.select("case").distinct().join(lacking, "case", "left").select(*_row("required_tables", F.col("case"), F.col("names").isNull(), F.coalesce("names", F.lit(""))))


# What a phase must have written; others need nothing. What every case has from the start.
PHASE_TABLES = {"Data Cleaning": ("cleaned_train", "cleaned_test"), "Feature Engineering": ("processed_train", "processed_test"), "Model Building, Validation, and Prediction": ("submission",)}
BASE_TABLES = ("train", "test", "sample_submission", "overview")


def phase_tables(cases: DataFrame, tables: DataFrame, base: bool = False) -> DataFrame:
    """required_tables for each (case, phase) of cases: what the phase must have written, with `base` also what every case
    has from the start. A case of which nothing is asked passes."""
    names = F.array(*[F.lit(n) for n in BASE_TABLES] if base else []).cast("array<string>")
    by_phase = F.lit(None).cast("array<string>")
    for phase, written in PHASE_TABLES.items():
        by_phase = F.when(F.col("phase") == phase, F.array(*map(F.lit, written))).otherwise(by_phase)
    asked = cases.select("case", F.explode_outer(F.concat(names, F.coalesce(by_phase, F.array().cast("array<string>")))).alias("table_name"))
    known = tables.select("case", "table_name").distinct().withColumn("known", F.lit(True))
    met = asked.distinct().join(known, ["case", "table_name"], "left")
    lacking = met.groupBy("case").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("known").isNull(), F.col("table_name")))), ",").alias("names"))
    return lacking.select(*_row("required_tables", F.col("case"), F.col("names") == "", F.col("names")))


def no_duplicate_rows(df: DataFrame, subject: str) -> DataFrame:
    extra = df.groupBy(*[name(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    return extra.select(*_row("no_duplicate_rows", subject, F.col("extra") == 0, F.col("extra")))


def no_missing_values(df: DataFrame, subject: str) -> DataFrame:
    """A row for each column with its missing cells."""
    wide = df.agg(*[F.count_if(value(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"m{i}").alias("m")) for i, c in enumerate(df.columns)])
    return wide.select(F.explode(rows).alias("r")).select(*_row("no_missing_values", F.concat(F.lit(subject + "."), F.col("r.c")), F.col("r.m") == 0, F.col("r.m")))


def no_duplicate_columns(columns: DataFrame) -> DataFrame:
    """A row for each table of columns(table_name, column_name), which keeps the header as it is."""
    names = columns.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n"))
    out = names.groupBy("table_name").agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("extra"))
    return out.select(*_row("no_duplicate_columns", F.col("table_name"), F.col("extra") == 0, F.col("extra")))


def feature_explosion(columns: DataFrame, pairs: DataFrame, factor: int = 3, floor: int = 50) -> DataFrame:
    """pairs(before, after): a table may have at most `factor` times the columns it had, or `floor`."""
    n = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(n.select(F.col("table_name").alias("before"), F.col("n").alias("n0")), "before").join(n.select(F.col("table_name").alias("after"), F.col("n").alias("n1")), "after")
    return both.select(*_row("feature_explosion", F.col("after"), (F.col("n1") <= factor * F.col("n0")) | (F.col("n1") <= floor), F.concat_ws("->", F.col("n0").cast("string"), F.col("n1").cast("string"))))


def target_columns(columns: DataFrame, train: str, test: str) -> DataFrame:
    """(column_name) of the train table that the test table lacks."""
    return columns.where(F.col("table_name") == train).select("column_name").join(columns.where(F.col("table_name") == test).select("column_name"), "column_name", "left_anti")


def target_count(columns: DataFrame, train: str, test: str, n_targets: int) -> DataFrame:
    """The train table has n_targets columns more than the test table, and all that the test table lacks are that many."""
    n = lambda t: F.count_if(F.col("table_name") == t)
    sizes = columns.agg((n(train) - n(test)).alias("more"))
    lacking = target_columns(columns, train, test).agg(F.count(F.lit(1)).alias("targets"))
    return sizes.crossJoin(F.broadcast(lacking)).select(*_row("target_count", f"{train},{test}", (F.col("more") == n_targets) & (F.col("targets") >= n_targets), F.col("more")))  # two single rows


def targets_consistent(columns: DataFrame, train: str, test: str, submission: str, id_names: tuple[str, ...] = ("id",)) -> DataFrame:
    """What the train table has and the test table lacks is what the submission has besides its id; neither is empty."""
    a = target_columns(columns, train, test).withColumn("a", F.lit(True))
    b = columns.where((F.col("table_name") == submission) & ~F.lower("column_name").isin(*id_names)).select("column_name", F.lit(True).alias("b"))
    both = a.join(b, "column_name", "full").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("odd"))
    return both.select(*_row("targets_consistent", f"{train},{submission}", (F.col("odd") == 0) & (F.col("n_a") > 0) & (F.col("n_b") > 0), F.col("odd")))


def features_consistent(columns: DataFrame, train: str, test: str, targets: DataFrame) -> DataFrame:
    """The test table has no column that the train table lacks, and the train table none besides these and the targets
    (column_name)."""
    of = lambda t: columns.where(F.col("table_name") == t).select("column_name")
    extra = of(test).join(of(train), "column_name", "left_anti").union(of(train).join(of(test), "column_name", "left_anti").join(targets.select("column_name"), "column_name", "left_anti"))
    return extra.agg(F.count(F.lit(1)).alias("n")).select(*_row("features_consistent", f"{train},{test}", F.col("n") == 0, F.col("n")))


def single_header(lines: DataFrame, separator: str = ",", threshold: float = 0.8, first: int = 5) -> DataFrame:
    """A row for each file of lines (file, n, text), n from 0: fails if 2 or 3 of the first lines in a row look like headers:
    no empty cell, and at least `threshold` of the cells no numbers. A file of one line passes."""
    cells = F.split("text", F.lit(f"\\{separator}"))
    empty = F.exists(cells, lambda x: F.lower(F.trim(x)).isin("", "nan"))
    words = F.size(F.filter(cells, lambda x: F.trim(x).try_cast("double").isNull())) / F.size(cells)
    top = lines.where(F.col("n") < first).select("file", "n", (~empty & (words >= threshold)).alias("header"))
    runs = top.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.min(F.when(~F.col("header"), F.col("n"))), F.max("n") + 1).alias("headers"))
    return runs.select(*_row("single_header", F.col("file"), (F.col("lines") < 2) | ~F.col("headers").between(2, 3), F.col("headers")))


def has_id_column(columns: DataFrame, names: list[str]) -> DataFrame:
    """A row for each table: passes if a column has one of the names, case ignored."""
    out = columns.groupBy("table_name").agg(F.count_if(F.lower("column_name").isin(names)).alias("n"))
    return out.select(*_row("has_id_column", F.col("table_name"), F.col("n") > 0, F.col("n")))


def rows_preserved(a: DataFrame, b: DataFrame, subject: str) -> DataFrame:
    n = a.agg(F.count(F.lit(1)).alias("n0")).crossJoin(b.agg(F.count(F.lit(1)).alias("n1")))
    return n.select(*_row("rows_preserved", subject, F.col("n0") == F.col("n1"), F.col("n1") - F.col("n0")))


def same_columns(columns: DataFrame, a: str, b: str) -> DataFrame:
    """Names and order of the columns of two tables."""
    names = lambda t: columns.where(F.col("table_name") == t).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda s: s["column_name"]).alias(f"n_{'a' if t == a else 'b'}"))
    return names(a).crossJoin(names(b)).select(*_row("same_columns", f"{a},{b}", F.col("n_a") == F.col("n_b"), F.size("n_a") - F.size("n_b")))


def consecutive_ids(df: DataFrame, column: str, subject: str) -> DataFrame:
    """Integer ids without nulls, repeats or gaps."""
    x = name(column)
    s = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(x).alias("d"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return s.select(*_row("consecutive_ids", subject, F.coalesce((F.col("n") == F.col("d")) & (F.col("hi") - F.col("lo") + 1 == F.col("n")), F.lit(False)), F.col("n") - F.col("d")))


def same_ids(a: DataFrame, b: DataFrame, subject: str) -> DataFrame:
    """The same ids, as often: rows (id) of both tables."""
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("n")).select(*_row("same_ids", subject, F.col("n") == 0, F.col("n")))


def prediction_plausible(predictions: DataFrame, sample: DataFrame, id_col: str, column: str, subject: str) -> DataFrame:
    """0/1 predictions pass; else the mean of the first 100 by id must be within a factor of 10 of the sample's."""
    first = lambda d, k: d.orderBy(id_col).limit(100).agg(F.avg(name(column).cast("double")).alias(k))
    binary = predictions.agg(F.bool_and(name(column).cast("double").isin(0.0, 1.0)).alias("binary"))
    both = binary.crossJoin(first(predictions, "m0")).crossJoin(first(sample, "m1"))
    near = (F.abs("m0") <= 10 * F.abs("m1")) & (F.abs("m0") * 10 >= F.abs("m1"))
    return both.select(*_row("prediction_plausible", subject, F.coalesce("binary", F.lit(False)) | F.coalesce(near, F.lit(False)), F.bround("m0", 4)))


def run_phase(phase: str, suites: dict[str, list[str]], checks: dict[str, Callable[[], DataFrame]], first: str = "required_tables") -> DataFrame:
    """The failed rows of the checks that suites[phase] lists, in their order. Checks after `first` are neither planned nor run if a row of it
    fails, since the tables they read may not be there; names without a check are passed over, and a phase without a suite fails nothing.

    Only whether `first` failed reaches the driver.
    """
    failed = None
    for listed in suites.get(phase, []):
        if listed not in checks:
            continue
        rows = checks[listed]().where(~F.coalesce("passed", F.lit(False))).select("check", "subject", "passed", "detail")
        failed = rows if failed is None else failed.unionByName(rows)
        if listed == first and not rows.isEmpty():
            break
    return SparkSession.active().createDataFrame([], "check string, subject string, passed boolean, detail string") if failed is None else failed


def run_checks(*checks: DataFrame) -> DataFrame:
    """All rows of the checks."""
    return reduce(DataFrame.unionByName, checks)
