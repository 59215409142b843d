"""Profiles of a lake's columns, similarity edges between them, and discovery over both."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import name, value
from ..functions.labels import make_label, path_id
from ..functions.metric import near_pairs, top_pairs
from ..functions.quantiles import exact_quantiles
from ..sources.shared import cut
from .pipelines import cosine


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(t, T.NumericType):
        return "float"
    return "boolean" if isinstance(t, T.BooleanType) else "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


def lake_columns(tables: dict[str, DataFrame], source: str, dataset: str) -> DataFrame:
    """A row for each column of all tables, from their schemas alone: ids, position, name and type."""
    rows = [(table, i, f.name, _kind(f.dataType)) for table, df in tables.items() for i, f in enumerate(df.schema.fields)]
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
    ids = [F.lit(source), F.lit(dataset), F.col("table_name")]
    return out.select(path_id(*ids, F.col("column_name")).alias("column_id"), path_id(*ids).alias("table_id"), path_id(*ids[:2]).alias("dataset_id"), F.lit(source).alias("data_source"), F.lit(dataset).alias("dataset_name"), "table_name", "position", "column_name", "data_type")


def lake_sizes(tables: dict[str, DataFrame], source: str, dataset: str) -> DataFrame:
    """lake_columns with total_values_count: the tables are counted, which takes no column."""
    counts = reduce(DataFrame.union, [df.select(F.lit(name).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("total_values_count")) for name, df in tables.items()])
    return lake_columns(tables, source, dataset).join(F.broadcast(counts), "table_name", "left").fillna(0, ["total_values_count"])  # a row for each table


NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def _cells(df: DataFrame, first: int) -> DataFrame:
    """(column, hash, hash2) of the known cells of a table's columns, numbered from `first` as text, but nested ones; one pass.

    The first hash tells numbers and dates of up to 8 bytes apart without fail, so only strings and longer numbers need
    the second one.
    """
    cells = []
    for i, f in enumerate(df.schema.fields):
        if not isinstance(f.dataType, NESTED):
            x = value(df, f.name)
            second = F.xxhash64(x, F.lit("second")) if isinstance(f.dataType, (T.StringType, T.DecimalType)) else F.lit(0).cast("long")
            cells.append(F.when(x.isNotNull(), F.struct(F.xxhash64(x).alias("hash"), second.alias("hash2"))).alias(str(first + i)))
    wide = df.select(*cells)
    return wide.unpivot([], wide.columns, "column", "cell").where("cell IS NOT NULL").select("column", "cell.*")


def _statistics(df: DataFrame, table: str) -> list[tuple]:
    """Counts and numbers of each column, in one wide aggregation and what exact_quantiles takes."""
    fields = [(i, f.name, _kind(f.dataType)) for i, f in enumerate(df.schema.fields)]
    numbers = [c for _, c, kind in fields if kind in ("int", "float")]
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, c, kind in fields:
        x = value(df, c)
        aggs.append(F.count_if(x.isNull()).alias(f"missing{i}"))
        if kind in ("int", "float"):
            n = x.cast("double")
            aggs += [F.min(n).alias(f"min{i}"), F.max(n).alias(f"max{i}"), F.avg(n).alias(f"mean{i}")]
        if kind == "boolean":
            aggs.append((F.count_if(x) / F.count(F.lit(1))).alias(f"true{i}"))
    row = df.agg(*aggs).first().asDict()
    quartiles = exact_quantiles(df, numbers, [0.25, 0.5, 0.75])
    out = []
    for i, c, _ in fields:
        low, median, high = quartiles.get(c, (None, None, None))
        out.append((table, i, row["total"], row[f"missing{i}"], *(row.get(f"{k}{i}") for k in ("min", "max", "mean")), median, None if median is None else high - low, row.get(f"true{i}")))
    return out


def profile_lake(tables: dict[str, DataFrame], source: str, dataset: str) -> DataFrame:
    """A row for each column of all tables: ids, type, counts, and min, max, mean, median and interquartile range of
    numbers and the share of true (null counts as false) of booleans. Columns of nested types have no distinct count.

    The profiles are computed when this is called, and the result is a local table: as many rows as the schemas have
    columns. Distinct values are counted as pairs of 64-bit hashes, in one aggregation over all tables.
    """
    spark = next(iter(tables.values())).sparkSession
    numbers = {(t, i): n for n, (t, i) in enumerate((t, i) for t, df in tables.items() for i in range(len(df.columns)))}
    cells = reduce(DataFrame.union, [_cells(df, numbers[t, 0]) for t, df in tables.items() if any(not isinstance(f.dataType, NESTED) for f in df.schema.fields)])
    per_column = cells.distinct().groupBy("column").count()
    with ThreadPoolExecutor(8) as several:  # the tables' jobs run side by side
        found = several.submit(lambda: {int(r[0]): r[1] for r in per_column.collect()})  # a row for each column
        statistics = [r for own in several.map(lambda item: _statistics(item[1], item[0]), tables.items()) for r in own]
        found = found.result()
    distinct = {k: None if isinstance(tables[k[0]].schema[k[1]].dataType, NESTED) else found.get(n, 0) for k, n in numbers.items()}
    rows = [(*r[:4], distinct[r[:2]], *r[4:]) for r in statistics]
    counted = spark.createDataFrame(
        rows, "table_name string, position int, total_values_count long, missing_values_count long, distinct_values_count long, min_value double, max_value double, mean double, median double, iqr double, true_ratio double"
    )
    columns = lake_columns(tables, source, dataset)
    return columns.join(F.broadcast(counted), ["table_name", "position"]).select(*columns.columns, *counted.columns[2:])


def profile_table(df: DataFrame, source: str, dataset: str, table: str) -> DataFrame:
    """The profiles of one table's columns."""
    return profile_lake({table: df}, source, dataset)


def detect_types(df: DataFrame) -> DataFrame:
    """(column_name, data_type) found from all values: the schema's boolean, int, float or date, where ints of exactly 0 and
    1 are boolean; of strings, the first that all known values are: int (boolean for 0 and 1), float, boolean; date where
    over half of the known values are one of under 50 signs; natural_language_text where over half of them have two words
    or more, mostly of letters; else string. A column without known values is a string."""
    half = lambda cond, x: F.count_if(cond) > 0.5 * F.count(x)
    aggs = []
    for i, f in enumerate(df.schema.fields):
        x, kind = value(df, f.name), _kind(f.dataType)
        bits = lambda n, x=x: (F.count_if(~n.isin(0, 1)) == 0) & (F.min(n) == 0) & (F.max(n) == 1)
        if kind == "int":
            found = F.when(bits(x), "boolean").otherwise("int")
        elif kind != "string" or not isinstance(f.dataType, T.StringType):
            found = F.lit(kind)
        else:
            every = lambda y, x=x: F.count(y) == F.count(x)
            whole, real = x.try_cast("bigint"), x.try_cast("double")
            date = F.coalesce(x.try_cast("date").isNotNull(), F.lit(False)) & (F.length(x) < 50) & x.rlike("[0-9]")
            words = F.regexp_count(F.substring(x, 1, 100), F.lit(r"\S+"))
            letters = F.regexp_count(F.substring(x, 1, 100), F.lit(r"(?<!\S)\p{L}+[.,;:!?]?(?!\S)"))
            found = (
                F.when(F.count(x) == 0, "string").when(every(whole), F.when(bits(whole), "boolean").otherwise("int")).when(every(real), "float")
                .when(every(F.when(F.lower(x).isin("true", "false"), 1)), "boolean").when(half(date, x), "date")
                .when(half((words >= 2) & (letters > 0.5 * words), x), "natural_language_text").otherwise("string")
            )
        aggs.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), found.alias("data_type")).alias(f"c{i}"))
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(aggs))])).alias("r")).select("r.column_name", "r.data_type")


def schema_diff(columns: DataFrame, before: str, after: str) -> DataFrame:
    """(column_name, change): columns of two tables that were added, removed or kept."""
    names = lambda t, k: columns.where(F.col("table_name") == t).select("column_name", F.lit(True).alias(k))
    both = names(before, "old").join(names(after, "new"), "column_name", "full")
    return both.select("column_name", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("kept").alias("change"))


def table_ids(columns: DataFrame, dataset: str, table: str) -> DataFrame:
    """(table_id) of the tables of a data set with this name."""
    return columns.where((F.col("dataset_name") == dataset) & (F.col("table_name") == table)).select("table_id").distinct()


# Fields of a case that may be asked for.
CASE_FIELDS = ("overview", "data_description", "problem_type", "data_type", "evaluation", "title")


def case_field(cases: DataFrame, case_id, field: str) -> DataFrame:
    """(value) of one allowed field of a case."""
    if field not in CASE_FIELDS:
        raise ValueError(f"no such field: {field}")
    return cases.where(F.col("case_id") == case_id).select(F.col(field).alias("value"))


# The signs of a text that have a bit each, as a pattern; letters of both cases count.
SIGN_BITS = [*"abcdefghijklmnopqrstuvwxyz", "[0-9]", r"\s", "[-_./:]", "[^ -~]", r"^\S*$", "^.{0,8}$"]


def _ones(cells: pa.Array) -> np.ndarray:
    """How many cells have each of their 32 bits set, lowest first."""
    if pa.types.is_floating(cells.type):
        with np.errstate(over="ignore"):
            f = cells.to_numpy(zero_copy_only=False).astype(np.float32)
        bits = np.where(f == 0, np.float32(0), f).view(np.uint32)  # both zeros alike
        return np.array([np.count_nonzero(bits >> np.uint32(k) & np.uint32(1)) for k in range(32)], np.int64)
    low = pc.utf8_lower(cells)
    return np.array([pc.sum(pc.match_substring(low, p) if len(p) == 1 else pc.match_substring_regex(low, p)).as_py() or 0 for p in SIGN_BITS], np.int64)


def content_vectors(tables: dict[str, DataFrame], source: str, dataset: str) -> DataFrame:
    """(column_id, embedding) of each column with a known value: the mean of 32 bits over all known values, lowest bit first. Of numbers,
    and of dates as seconds, these are the bits of the single-precision float; of texts, which letters and kinds of signs
    they have (`SIGN_BITS`). Booleans and nested types have no row.

    Each task counts set bits column by column over its batches and gives one row for each column, so one pass over each table does, and
    next to nothing is shuffled.
    """
    parts, names = [], []
    for table, df in tables.items():
        cells = []
        for f in df.schema.fields:
            kind, x = _kind(f.dataType), value(df, f.name)
            if not isinstance(f.dataType, NESTED) and kind != "boolean":
                cells.append((x.cast("string") if kind == "string" else (x.cast("timestamp") if kind == "date" else x).cast("double")).alias(f"c{len(cells)}"))
                names.append((len(names), table, f.name))
        first = len(names) - len(cells)

        def count(batches: Iterator[pa.RecordBatch], first: int = first, many: int = len(cells)) -> Iterator[pa.RecordBatch]:
            n, ones = np.zeros(many, np.int64), np.zeros((many, 32), np.int64)
            for batch in batches:
                for i, column in enumerate(batch.columns):
                    known = column.drop_null()
                    n[i] += len(known)
                    if len(known):
                        ones[i] += _ones(known)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + many), pa.int32()), pa.array(n), pa.array(ones.tolist(), pa.list_(pa.int64()))], ["column", "n", "ones"])

        if cells:
            parts.append(df.select(*cells).mapInArrow(count, "column int, n long, ones array<long>"))
    spark = next(iter(tables.values())).sparkSession
    named = spark.createDataFrame(names, "column int, table_name string, column_name string")
    if not parts:
        return named.select(F.col("table_name").alias("column_id"), F.array().cast("array<double>").alias("embedding")).limit(0)
    sums = reduce(DataFrame.union, parts).groupBy("column").agg(F.sum("n").alias("n"), *[F.sum(F.get("ones", F.lit(k))).alias(f"b{k}") for k in range(32)]).where("n > 0")
    means = sums.select("column", F.array(*[F.col(f"b{k}") / F.col("n") for k in range(32)]).alias("embedding"))
    return means.join(F.broadcast(named), "column").select(path_id(F.lit(source), F.lit(dataset), F.col("table_name"), F.col("column_name")).alias("column_id"), "embedding")  # a row for each column


def text_vectors(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, vector, scale) of texts (id, text): the mean vector of a text's words in words (word, vector of one length), repeats
    counted, and its largest absolute component. Texts without a known word have no row."""
    head = words.select(F.size("vector").alias("n")).where("n >= 0").first()
    length = head.n if head else 0
    met = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\w+)"), F.lit(1))).alias("word")).join(words.where(F.size("vector") == length), "word")
    means = F.array(*[F.avg(F.element_at("vector", i + 1).cast("double")) for i in range(length)])
    return met.groupBy("id").agg(means.alias("vector")).select("id", "vector", F.array_max(F.transform("vector", F.abs)).alias("scale"))


def profile_sample(df: DataFrame, key: str, large: int = 10_000, few: int = 1_000) -> DataFrame:
    """The rows that costly profiles may read: about a tenth of a table of over `large` rows, else the first `few`, both by
    the md5 of the key, so that reruns agree. Rows without a key are never in a tenth."""
    spread = F.md5(name(key).cast("string"))
    if df.count() > large:
        return df.where(F.conv(F.substring(spread, 1, 7), 16, 10).cast("long") % 10 == 0)
    return df.orderBy(spread, name(key)).limit(few)


def replace_profiles(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored with the fresh profiles in place of those of the same data sets and tables."""
    return stored.join(fresh.select("dataset_name", "table_name").distinct(), ["dataset_name", "table_name"], "left_anti").unionByName(fresh)


def ask(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A query of the caller's own, which names tables in braces."""
    return next(iter(tables.values())).sparkSession.sql(sql, **tables)


def label_tokens(label: Column, prefix: str = "") -> Column:
    """Distinct words of a label."""
    return F.array_sort(F.array_distinct(F.split(make_label(F.regexp_replace(label, prefix, "") if prefix else label), " ")))


def label_similarity(columns: DataFrame, least: float = 0.75, prefix: str = "") -> DataFrame:
    """(column_id_1, column_id_2, kind, certainty) of columns of one type in different tables whose label words have a
    Jaccard similarity of at least `least`; each pair once. Pairs come from an equi-join on words, counted."""
    words = columns.select("column_id", "table_id", "data_type", label_tokens(F.col("column_name"), prefix).alias("words")).withColumn("n", F.size("words"))
    one = words.select("column_id", "table_id", "data_type", "n", F.explode("words").alias("word"))
    a, b = one.alias("a"), one.alias("b")
    met = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.data_type") == F.col("b.data_type")) & (F.col("a.column_id") < F.col("b.column_id")) & (F.col("a.table_id") != F.col("b.table_id")))
    counted = met.groupBy(F.col("a.column_id").alias("column_id_1"), F.col("b.column_id").alias("column_id_2")).agg(F.count(F.lit(1)).alias("common"), F.first("a.n").alias("n1"), F.first("b.n").alias("n2"))
    certainty = F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))
    return counted.select("column_id_1", "column_id_2", F.lit("label").alias("kind"), certainty.alias("certainty")).where(F.col("certainty") >= least)


def content_similarity(columns: DataFrame, least: float = 0.75, scale: str | None = None) -> DataFrame:
    """Edges of columns of one type in different tables with 1 - tanh(distance of their embeddings) >= least; with `scale`,
    a column of values of at least 0, both columns' scales are added to the distance, and a null scale makes no edge.

    At 0.75 the distance is at most 0.2554 in all dimensions together, so pairs come from the cells of `near_pairs`."""
    known = columns.where("embedding IS NOT NULL")
    found = near_pairs(known.select(F.col("column_id").alias("id"), F.col("data_type").alias("group"), F.col("embedding").alias("vector")), math.atanh(1 - least) + 1e-9)
    side = lambda i: known.select(F.col("column_id").alias(f"id_{i}"), F.col("table_id").alias(f"t{i}"), (name(scale).cast("double") if scale else F.lit(0.0)).alias(f"s{i}"))
    met = found.join(side(1), "id_1").join(side(2), "id_2").where("t1 <> t2")
    certainty = 1 - F.tanh(F.col("distance") + F.col("s1") + F.col("s2"))
    return met.select(F.col("id_1").alias("column_id_1"), F.col("id_2").alias("column_id_2"), F.lit("content").alias("kind"), certainty.alias("certainty")).where(F.col("certainty") >= least)


def word_label_similarity(columns: DataFrame, words: DataFrame, least: float = 0.75, prefix: str = "") -> DataFrame:
    """(column_id_1, column_id_2, kind, certainty) of columns of one type in different tables, by word vectors: certainty is 1 for equal
    labels, else the mean inner product of the unit vectors of one label's words with the other's; 0 if a word has no
    vector. Words that both labels have are left out where both have several words, unless one label has no other word; labels of
    the same words have 1. words: (word, vector), each word once, vectors of one length.

    Only distinct labels are compared. A mean of at least `least` takes a pair of words with such a product, so candidates are labels
    with two near words (`near_pairs` over distinct words), those where one label is one word of the other, and those
    where one has all words of the other, found by its rarest one. A common word alone makes no candidate.
    """
    label = make_label(F.regexp_replace("column_name", prefix, "") if prefix else F.col("column_name"))
    named = cut(columns.select("column_id", "table_id", "data_type", label.alias("label")))
    labels = cut(named.select("label").distinct().withColumn("tokens", F.split("label", " ")))
    one = labels.select("label", F.size("tokens").alias("n"), F.explode(F.array_distinct("tokens")).alias("word")).where("word <> ''")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = cut(words.join(one.select("word").distinct(), "word", "left_semi").select("word", F.transform("vector", lambda x: F.try_divide(x.cast("double"), length)).alias("vector")).where(~F.exists("vector", lambda x: x.isNull())))
    near = near_pairs(unit.select(F.col("word").alias("id"), F.lit("w").alias("group"), "vector"), math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9)
    both = near.select(F.col("id_1").alias("word"), F.col("id_2").alias("other")).union(near.select("id_2", "id_1"))
    other = one.select(F.col("label").alias("label_2"), F.col("word").alias("other"))
    by_near = one.select(F.col("label").alias("label_1"), "word").join(both, "word").join(other, "other").select("label_1", "label_2")
    by_word = one.where("n = 1").select(F.col("label").alias("label_1"), F.col("word").alias("other")).join(other, "other").select("label_1", "label_2")
    often = one.groupBy("word").count()
    rarest = one.where("n > 1").join(often, "word").groupBy("label").agg(F.min_by("word", F.struct("count", "word")).alias("other"))
    sets = labels.select("label", F.array_distinct("tokens").alias("set"))
    held = rarest.withColumnRenamed("label", "label_1").join(other, "other").join(sets.select(F.col("label").alias("label_1"), F.col("set").alias("a")), "label_1").join(sets.select(F.col("label").alias("label_2"), F.col("set").alias("b")), "label_2")
    by_set = held.where(F.size(F.array_except("a", "b")) == 0).select("label_1", "label_2")
    pairs = by_near.union(by_word).union(by_set).where("label_1 <> label_2").select(F.least("label_1", "label_2").alias("label_1"), F.greatest("label_1", "label_2").alias("label_2")).distinct()
    sides = [labels.select(F.col("label").alias(f"label_{i}"), F.col("tokens").alias(t)) for i, t in ((1, "a"), (2, "b"))]
    met = pairs.join(sides[0], "label_1").join(sides[1], "label_2")
    shared = F.array_intersect("a", "b")
    less = lambda c: F.filter(c, lambda w: ~F.array_contains(shared, w))
    many = (F.size("a") > 1) & (F.size("b") > 1)
    met = met.select("label_1", "label_2", "a", "b", F.when(many, less("a")).otherwise(F.col("a")).alias("x"), F.when(many, less("b")).otherwise(F.col("b")).alias("y"))
    alike = (F.size("x") == 0) & (F.size("y") == 0)
    whole = (F.size("x") == 0) != (F.size("y") == 0)
    met = cut(met.select("label_1", "label_2", alike.alias("alike"), F.when(whole, F.col("a")).otherwise(F.col("x")).alias("x"), F.when(whole, F.col("b")).otherwise(F.col("y")).alias("y")))
    product = F.aggregate(F.zip_with("v", "u", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    combined = met.where("NOT alike").select("label_1", "label_2", F.explode("x").alias("word"), "y").select("label_1", "label_2", "word", F.explode("y").alias("other"))
    scored = combined.join(unit.select("word", F.col("vector").alias("v")), "word", "left").join(unit.select(F.col("word").alias("other"), F.col("vector").alias("u")), "other", "left")
    means = scored.groupBy("label_1", "label_2").agg(F.when(F.count_if(F.col("v").isNull() | F.col("u").isNull()) == 0, F.avg(product)).otherwise(0.0).alias("certainty"))
    same = named.select(F.col("label").alias("label_1"), F.col("label").alias("label_2")).distinct().select("*", F.lit(1.0).alias("certainty"))
    scores = cut(means.union(met.where("alike").select("label_1", "label_2", F.lit(1.0))).where(F.col("certainty") >= least).union(same))
    turned = scores.union(scores.where("label_1 <> label_2").select("label_2", "label_1", "certainty"))
    a = named.select(F.col("label").alias("label_1"), F.col("column_id").alias("column_id_1"), F.col("table_id").alias("t1"), F.col("data_type").alias("d1"))
    b = named.select(F.col("label").alias("label_2"), F.col("column_id").alias("column_id_2"), F.col("table_id").alias("t2"), F.col("data_type").alias("d2"))
    edges = a.join(turned, "label_1").join(b, "label_2").where("column_id_1 < column_id_2 AND t1 <> t2 AND d1 = d2")
    return edges.select("column_id_1", "column_id_2", F.lit("label").alias("kind"), "certainty")


def boolean_similarity(columns: DataFrame, least: float = 0.75) -> DataFrame:
    """Edges of boolean columns with 1 - |difference of their shares of true| >= least, by a band join."""
    width = 1 - least
    rows = columns.where("data_type = 'boolean' AND true_ratio IS NOT NULL").select("column_id", "table_id", "true_ratio", F.floor(F.col("true_ratio") / width).alias("cell"))
    near = rows.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    a, b = rows.alias("a"), near.alias("b")
    met = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.column_id") < F.col("b.column_id")) & (F.col("a.table_id") != F.col("b.table_id")))
    return met.select(F.col("a.column_id").alias("column_id_1"), F.col("b.column_id").alias("column_id_2"), F.lit("content").alias("kind"), (1 - F.abs(F.col("a.true_ratio") - F.col("b.true_ratio"))).alias("certainty")).where(F.col("certainty") >= least)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("column_id_2").alias("column_id_1"), F.col("column_id_1").alias("column_id_2"), "kind", "certainty"))


def related_tables(edges: DataFrame, columns: DataFrame, table_id: str | None, k: int, kind: str) -> DataFrame:
    """(table_id, related_table_id, score): the k tables with the largest sums of certainties of the kind (content:
    joinable, label: unionable), over the largest sum, two decimals. For one table, or for all at once."""
    of = columns.select("column_id", "table_id")
    a, b = of.alias("a"), of.alias("b")
    met = both_ways(edges.where(F.col("kind") == kind)).join(a, F.col("column_id_1") == F.col("a.column_id")).join(b, F.col("column_id_2") == F.col("b.column_id"))
    sums = met.groupBy(F.col("a.table_id").alias("table_id"), F.col("b.table_id").alias("related_table_id")).agg(F.sum("certainty").alias("total"))
    if table_id is not None:
        sums = sums.where(F.col("table_id") == table_id)
    per = Window.partitionBy("table_id")
    ranked = sums.withColumn("n", F.row_number().over(per.orderBy(F.col("total").desc(), "related_table_id"))).withColumn("top", F.max("total").over(per))
    return ranked.where(F.col("n") <= k).select("table_id", "related_table_id", F.bround(F.col("total") / F.col("top"), 2).alias("score"))


def join_paths(edges: DataFrame, columns: DataFrame, source: str, target: str, hops: int, kind: str = "content") -> DataFrame:
    """(t0, ..., thops, steps, certainty): paths of `hops` steps from a column of one table to a similar one of another, between two
    tables; steps: the pair of columns of each step; certainty: the product of theirs.

    Paths grow from both ends, half of the steps from each, and meet in the middle table by an equi-join: the target cuts the last
    half down from its first step on, and no path of more than half of the steps is made that doesn't arrive.
    """
    of = columns.select("column_id", "table_id")
    step = both_ways(edges.where(F.col("kind") == kind)).join(of.select(F.col("column_id").alias("column_id_1"), F.col("table_id").alias("src")), "column_id_1").join(of.select(F.col("column_id").alias("column_id_2"), F.col("table_id").alias("dst")), "column_id_2")
    step = step.select("src", "dst", F.struct(F.col("column_id_1").alias("a"), F.col("column_id_2").alias("b")).alias("by"), F.col("certainty").alias("c"))

    def grown(table: str, n: int, near: str, far: str) -> DataFrame | None:
        """Paths of n steps whose `near` end is the table: (end, tables, steps, c), in the order of walking from it."""
        path = None
        for _ in range(n):
            if path is None:
                path = step.where(F.col(near) == table).select(F.col(far).alias("end"), F.array(F.col(near), F.col(far)).alias("tables"), F.array("by").alias("steps"), "c")
            else:
                more = step.select(F.col(near).alias("end"), F.col(far).alias("next"), "by", F.col("c").alias("c2"))
                path = path.join(more, "end").select(F.col("next").alias("end"), F.concat("tables", F.array("next")).alias("tables"), F.concat("steps", F.array("by")).alias("steps"), (F.col("c") * F.col("c2")).alias("c"))
        return path

    ahead, back = grown(source, hops - hops // 2, "src", "dst"), grown(target, hops // 2, "dst", "src")
    if back is None:
        whole = ahead.where(F.col("end") == target)
    else:
        back = back.select("end", F.reverse("tables").alias("later"), F.reverse("steps").alias("last"), F.col("c").alias("c2"))
        whole = ahead.join(back, "end").select(F.concat("tables", F.slice("later", 2, hops)).alias("tables"), F.concat("steps", "last").alias("steps"), (F.col("c") * F.col("c2")).alias("c"))
    return whole.select(*[F.get("tables", F.lit(i)).alias(f"t{i}") for i in range(hops + 1)], "steps", F.col("c").alias("certainty"))


def graph_info(columns: DataFrame, pipelines: DataFrame) -> DataFrame:
    """(datasets, pipelines, tables, columns): what the lake holds, each once. columns: (column_id, table_id, dataset_id); pipelines:
    (pipeline_id, dataset_id), those of no dataset of the lake left out."""
    counts = columns.agg(F.count_distinct("dataset_id").alias("datasets"), F.count_distinct("table_id").alias("tables"), F.count_distinct("column_id").alias("columns"))
    own = pipelines.join(columns.select("dataset_id").distinct(), "dataset_id", "left_semi").agg(F.count_distinct("pipeline_id").alias("pipelines"))
    return counts.crossJoin(own).select("datasets", "pipelines", "tables", "columns")  # one row each


def datasets_info(columns: DataFrame) -> DataFrame:
    return columns.groupBy("dataset_name").agg(F.count_distinct("table_id").alias("n_tables")).orderBy("dataset_name")


def tables_info(columns: DataFrame, dataset: str = "") -> DataFrame:
    """(dataset_name, table_name, n_rows, n_columns)."""
    chosen = columns.where(F.col("dataset_name") == dataset) if dataset else columns
    return chosen.groupBy("dataset_name", "table_name").agg(F.max("total_values_count").alias("n_rows"), F.count(F.lit(1)).alias("n_columns"))


def search_tables(columns: DataFrame, conditions: list[list[str]]) -> DataFrame:
    """(table_name, n_columns, n_rows) of tables with, for each condition, a column whose label has one of its words; most rows first."""
    tables = columns.groupBy("table_id", "table_name").agg(F.count_distinct("column_id").alias("n_columns"), F.max("total_values_count").alias("n_rows"))
    for words in conditions:
        hit = columns.where(F.col("column_name").rlike("(?i)" + "|".join(words))).select("table_id")
        tables = tables.join(hit, "table_id", "left_semi")
    return tables.select("table_name", "n_columns", "n_rows").orderBy(F.col("n_rows").desc(), "table_name")


def membership_triples(columns: DataFrame) -> DataFrame:
    """(s, p, o): columns are part of tables, tables of datasets, datasets of sources; each once."""
    part = lambda a, b: columns.select(F.col(a).alias("s"), F.lit("isPartOf").alias("p"), F.col(b).alias("o")).distinct()
    return part("column_id", "table_id").union(part("table_id", "dataset_id")).union(part("dataset_id", "data_source"))


def descendants(triples: DataFrame, root: str) -> DataFrame:
    """(node) of all that is part of the root, directly or not: one more step until nothing is new, so cycles end too."""
    parts = triples.where(F.col("p") == "isPartOf").select(F.col("s").alias("node"), F.col("o").alias("whole"))
    front = cut(parts.where(F.col("whole") == root).select("node").distinct())
    out = front
    while not front.isEmpty():
        front = cut(parts.join(front.select(F.col("node").alias("whole")), "whole").select("node").distinct().join(out, "node", "left_anti"))
        out = out.union(front)
    return out


def flag_operations(columns: DataFrame, operations: DataFrame) -> DataFrame:
    """columns with has_ops: whether operations(column_id) has any for it."""
    used = operations.select("column_id").distinct().withColumn("has_ops", F.lit(True))
    return columns.join(used, "column_id", "left").fillna(False, ["has_ops"])


def recommend_charts(similar: DataFrame, operations: DataFrame) -> DataFrame:
    """(query_id, analysis_type, chart_type, column_id): charts of each query column's nearest columns, nearest first.
    similar: (query_id, column_id, place); operations: (column_id, analysis_type, chart_type)."""
    met = similar.join(operations, "column_id")
    w = Window.partitionBy("query_id", "analysis_type", "chart_type").orderBy("place", "column_id")
    return met.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "analysis_type", "chart_type", "column_id")


# Charts over all columns of a table, which name none.
WHOLE_TABLE_CHARTS = ("heatmap", "pairwise")


def recommend_joint_charts(mains: DataFrame, operations: DataFrame, columns: DataFrame, own: DataFrame) -> DataFrame:
    """(query_table, main_column, eda_id, partner_id, analysis_type, chart_type, chart_columns): charts of two and more columns for a table's column
    by what was drawn with the library column most similar to it.

    mains: (query_table, main_column, similar_id); operations: (eda_id, column_id, analysis_type, chart_type), a row for each column
    of an operation; columns: (column_id, data_type, vector) of the library; own: (query_table, name, data_type, vector) of the tables asked
    about. A bivariate operation gives a row for each other column of it (partner_id): the main column and the table's
    nearest other column of the partner's type, by cosine, ties by name. A multivariate one gives one row: each of its other
    columns, by id, takes the nearest column of its type that isn't used yet; fewer than three columns make no chart, but
    charts over the whole table need none. Names come in order.

    Nearest columns are ranked once for each table and partner, over that table's columns of one type, in blocks, as `top_pairs`;
    cosines are compared at twelve decimals. Of the ranking only as many names are kept as the columns of an operation can use up.
    Vectors of another length, or with cells that are missing or not finite, aren't near.
    """
    drawn = operations.select("eda_id", "column_id", "analysis_type", "chart_type").distinct()
    asked = mains.join(drawn.withColumnRenamed("column_id", "similar_id"), "similar_id")
    several = asked.where(F.col("analysis_type").isin("bivariate", "multivariate"))
    other = drawn.select("eda_id", "analysis_type", "chart_type", F.col("column_id").alias("partner_id"))
    met = cut(several.join(other, ["eda_id", "analysis_type", "chart_type"], "left").where("partner_id <> similar_id"))
    wanted = cut(met.select("query_table", "partner_id").distinct().join(columns.select(F.col("column_id").alias("partner_id"), "data_type", F.col("vector").alias("v")), "partner_id"))
    named = cut(own.where("name IS NOT NULL").select("query_table", "data_type", "name", "vector").distinct())
    # an operation's main column and its partners before one use up as many names as the operation has columns, at most
    used = met.groupBy("query_table", "main_column", "eda_id", "analysis_type", "chart_type").count().agg(F.max("count")).first()[0] or 0
    again = lambda df, *k: df.groupBy(*k).count().agg(F.max("count")).first()[0] or 1  # noqa: E731  # rows of one id
    most = (used + 1) * again(named, "query_table", "name") * again(wanted, "query_table", "partner_id")
    group = lambda v: F.struct("query_table", "data_type", F.size(v).alias("size")).alias("group")
    whole_only = lambda df: df.where("query_table IS NOT NULL AND data_type IS NOT NULL AND forall(vector, x -> abs(x) < double('Infinity'))")
    asked_of = whole_only(wanted.withColumnRenamed("v", "vector")).select(F.struct("query_table", "partner_id").alias("query_id"), group("vector"), "vector")
    near = top_pairs(asked_of, whole_only(named).select(F.col("name").alias("id"), group("vector"), "vector"), most)
    ranked = near.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda n: n["id"]).alias("names")).select("query_id.*", "names")  # `most` names
    keys = ["query_table", "main_column", "eda_id"]
    placed = met.join(ranked, ["query_table", "partner_id"], "left")
    first = F.get(F.filter("names", lambda n: n != F.col("main_column")), F.lit(0))
    two = placed.where("analysis_type = 'bivariate'").select(*keys, "partner_id", "analysis_type", "chart_type", first.alias("second"), "main_column")
    pairs = two.where("second IS NOT NULL").select(*keys, "partner_id", "analysis_type", "chart_type", F.array_sort(F.array("main_column", "second")).alias("chart_columns"))
    lists = placed.where(F.col("analysis_type").eqNullSafe("multivariate") & ~F.col("chart_type").isin(*WHOLE_TABLE_CHARTS)).groupBy(*keys, "analysis_type", "chart_type").agg(F.sort_array(F.collect_list(F.struct("partner_id", "names"))).alias("partners"))

    def take(used: Column, partner: Column) -> Column:
        free = F.get(F.filter(partner["names"], lambda n: ~F.array_contains(used, n)), F.lit(0))
        return F.when(free.isNull(), used).otherwise(F.concat(used, F.array(free)))

    many = lists.select(*keys, F.lit(None).cast(columns.schema["column_id"].dataType).alias("partner_id"), "analysis_type", "chart_type", F.array_sort(F.aggregate("partners", F.array("main_column"), take)).alias("chart_columns")).where(F.size("chart_columns") > 2)
    whole = several.where((F.col("analysis_type") == "multivariate") & F.col("chart_type").isin(*WHOLE_TABLE_CHARTS)).join(met.select(*keys).distinct(), keys, "left_semi")
    whole = whole.select(*keys, F.lit(None).cast(columns.schema["column_id"].dataType).alias("partner_id"), "analysis_type", "chart_type", F.array().cast("array<string>").alias("chart_columns")).distinct()
    return pairs.union(many).union(whole)


def insight_triples(fields: DataFrame) -> DataFrame:
    """(s, p, o, o_type) of insight fields (case_id, module, field, kind, value); booleans in lower case."""
    o = F.when(F.col("kind") == "boolean", F.lower("value")).otherwise(F.col("value"))
    kind = F.when(F.col("kind").isin("float", "int"), "number").otherwise("text")
    return fields.select(F.concat_ws("/", "case_id", "module").alias("s"), F.concat(F.lit("has"), F.initcap(F.replace("field", F.lit("_"), F.lit(" ")))).alias("p"), o.alias("o"), kind.alias("o_type"))


def flatten_insight(documents: DataFrame, id_col: str, json_col: str, weighted: DataFrame) -> DataFrame:
    """(case_id, module, field, kind, value) rows of nested insight JSON {module: {field: value}}: the fields of weighted
    (field, kind), 'unknown' where a module lacks a value; booleans in lower case."""
    modules = documents.select(F.col(id_col).alias("case_id"), F.explode(F.from_json(json_col, "map<string, map<string, string>>")).alias("module", "fields"))
    out = modules.crossJoin(F.broadcast(weighted))  # a fixed list of fields
    raw = F.coalesce(F.try_element_at("fields", F.col("field")), F.lit("unknown"))
    return out.select("case_id", "module", "field", "kind", F.when(F.col("kind") == "boolean", F.lower(raw)).otherwise(raw).alias("value"))
