"""Small golden frames and edge frames for the library's operators."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import labels as L
from lakeloom.functions.metric import best_rows, near_pairs, top_pairs
from lakeloom.functions.quantiles import exact_quantiles
from lakeloom.operators import assertions as A
from lakeloom.operators import catalog as K
from lakeloom.operators import correlation as M
from lakeloom.operators import distributions as D
from lakeloom.operators import features as X
from lakeloom.operators import missing as C
from lakeloom.operators import models as G
from lakeloom.operators import outliers as O
from lakeloom.operators import pipelines as P
from lakeloom.operators import ranking as V
from lakeloom.operators import time_space as Z
from lakeloom.sources import lake as S


def column(df, c):
    return [r[c] for r in df.collect()]


@pytest.fixture
def gauges(spark):
    """Readings of a gauge: 4 of 16 cells are missing, one of them a NaN, and no reading is whole but the first and the last."""
    rows = [(11, 0.5, "north", 7.0), (12, 3.5, "south", None), (13, None, None, 9.0), (14, 6.5, "south", float("nan")), (15, 9.5, "west", 5.0)]
    return spark.createDataFrame(rows, "reading int, level double, wind string, flow double")


def test_gaps_are_filled_by_mean_mode_median_or_constant(gauges):
    filled = {r.reading: r for r in C.fill_missing(gauges, ["level", "wind"]).collect()}
    assert filled[13].level == pytest.approx(5.0) and filled[13].wind == "south" and filled[12].flow is None
    assert {r.reading: r.wind for r in C.fill_missing(gauges, ["wind"], "constant", "calm").collect()}[13] == "calm"
    assert {r.reading: r.flow for r in C.fill_missing(gauges, ["flow"], "median").collect()}[14] == 7.0


def test_nan_counts_as_missing(gauges):
    assert C.overall_missing_rate(gauges).first()[0] == 0.2
    assert C.row_completeness(gauges).first()[:2] == (0.4, 0.6)
    assert [r.column_share for r in C.column_missing_distribution(gauges).orderBy("bin").collect()] == [0.25, 0.5, 0.25, 0.0]


def test_sparse_columns_go(spark):
    rows = [(i, i if i < 2 else None, None if i < 4 else 1) for i in range(5)]
    df = spark.createDataFrame(rows, "full int, two_of_five int, last int")
    assert C.drop_sparse_columns(df).columns == ["full"]
    assert C.drop_sparse_columns(df, 0.7, ["full", "last"]).columns == ["full", "two_of_five"]


def test_outliers(spark):
    depths = [3.5, 4.0, 4.25, 4.5, 5.0, 5.5, 6.0, 41.0]
    df = spark.createDataFrame([(d, i * i) for i, d in enumerate(depths)], "depth double, square int")
    mean, sd = np.mean(depths), np.std(depths, ddof=1)
    assert sorted(column(O.zscore_outliers(df, ["depth"], 1.5), "depth")) == pytest.approx(sorted(np.clip(depths, mean - 1.5 * sd, mean + 1.5 * sd)))
    low, high = np.quantile(depths, [0.25, 0.75])
    assert sorted(column(O.iqr_outliers(df, ["depth"]), "depth")) == pytest.approx([*depths[:-1], high + 1.5 * (high - low)])
    assert sorted(column(O.iqr_outliers(df, ["depth"], method="remove"), "depth")) == depths[:-1]
    assert O.outlier_summary(df).first() == (0.5, 1, 0.0625)
    severe = spark.createDataFrame([(float(i), 0.0 if i < 90 else 1000.0 * i, 3.0) for i in range(100)], "even double, odd double, same double").withColumn("odd", F.col("odd") + F.col("even"))
    assert O.outlier_severity(severe).first() == (0.0, 0.3333, 0.0, 0.6667)
    assert O.outlier_severity(severe.select(F.lit("x").alias("text"))).first() == (0.0, 0.0, 0.0, 0.0)


def test_repeated_rows_go(spark):
    rows = [(1, "oak", 30), (2, "oak", 30), (3, "elm", 30), (4, "oak", 12), (5, "oak", 30)]
    df = spark.createDataFrame(rows, "n int, tree string, age int")
    assert sorted(column(C.remove_duplicates(df, ["tree", "age"], "first", "n"), "n")) == [1, 3, 4]
    assert sorted(column(C.remove_duplicates(df, ["tree"], "last", "n"), "n")) == [3, 5]
    assert sorted(column(C.remove_duplicates(df, ["tree", "age"], False), "n")) == [3, 4]


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "nulls"])
def test_exact_quantiles_equal_sorted_values(spark, kind):
    rng = np.random.default_rng(5)
    values = {"spread": rng.normal(size=30_000), "ties": rng.integers(0, 3, 20_000).astype(float), "few": np.array([4.0, 1.0]), "nulls": np.zeros(0)}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(5)
    got = exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.999, 1.0], accuracy=500)["x"]
    want = np.quantile(values, [0, 0.25, 0.5, 0.999, 1]).tolist() if len(values) else [None] * 5
    assert got == (pytest.approx(want) if len(values) else want)


def test_types_are_found_from_the_cells(spark):
    rows = [("1", "0", "2.5", "true", "2024-01-03", "A whole sentence, with words.", "x-17", None), ("-2", "1", "7", "False", "2024-02-05", "Another one of them", "y_18", None), (None, "0", "nan", "true", "soon", "two words", "z9", None)]
    df = spark.createDataFrame(rows, "i string, b string, f string, t string, d string, n string, s string, none string")
    assert [r.data_type for r in K.detect_types(df).collect()] == ["int", "boolean", "float", "boolean", "date", "natural_language_text", "string", "string"]
    assert [r.data_type for r in K.detect_types(spark.createDataFrame([(0, 5), (1, 6)], "bit int, other long")).collect()] == ["boolean", "int"]


@pytest.mark.parametrize(("text", "decision"), [
    ("Drop the columns with a constant value", "reject"), ("We filled missing values with the median", "reject"), ("one-hot encoding of the district", "reject"), ("Apply a log transform to the price", "reject"),
    ("remove duplicated rows first", "reject"), ("Scale all numeric features", "reject"), ("Sales dropped in March", "keep"), ("Large-scale surveys differ", "keep"), ("The glass is half filled", "keep"),
    ("Prices fell; demand transformed the market", "keep"), ("Look at the distribution of each column", "keep"),
])
def test_gate_asks_for_a_change_of_data(spark, text, decision):
    rows = spark.createDataFrame([(text, "EDA", False, False)], "text string, phase string, time_series boolean, grouped boolean")
    assert V.hard_gate(rows).first().decision == decision


def test_descendants_end_in_cycles(spark):
    chain = [(f"n{i + 1}", "isPartOf", f"n{i}") for i in range(7)] + [("n0", "isPartOf", "n7"), ("x", "near", "n0")]
    triples = spark.createDataFrame(chain, "s string, p string, o string")
    assert sorted(r.node for r in K.descendants(triples, "n0").collect()) == [f"n{i}" for i in range(8)]


def test_conversions(spark):
    df = spark.createDataFrame([("False", "1969-07-20 20:17:40"), (None, None), ("True", "the day after"), ("False", "2000-02-29 08:00:00")], "landed string, at string")
    assert column(df.select(L.convert(F.col("landed"), "bool").alias("x")), "x") == [True, False, True, True]
    assert column(df.select(L.format_datetime(F.col("at"), "%Y-%m-%d").alias("x")), "x") == ["1969-07-20", None, None, "2000-02-29"]


def test_encoders(spark):
    birds = [(0, "wren", 3.0), (1, "owl", 9.0), (2, "wren", 5.0), (3, None, 1.0), (4, "wren", 4.0), (5, "heron", 8.0)]
    df = spark.createDataFrame(birds, "i int, bird string, eggs double")
    assert column(X.label_encode(df.where("bird IS NOT NULL"), ["bird"]).orderBy("i"), "bird_encoded") == [2, 1, 2, 2, 0]
    shares = column(X.frequency_encode(df.where("bird IS NOT NULL"), ["bird"]).orderBy("i"), "bird_freq")
    assert shares == pytest.approx([0.6, 0.2, 0.6, 0.6, 0.2])
    whole = np.mean([e for _, b, e in birds if b])
    of = lambda b: [e for _, x, e in birds if x == b]
    weight = lambda b: 1 / (1 + math.exp(1 - len(of(b))))  # noqa: E731  of a group's own mean
    want = [weight(b) * np.mean(of(b)) + (1 - weight(b)) * whole for _, b, _ in birds if b]
    assert column(X.target_encode(df.where("bird IS NOT NULL"), ["bird"], "eggs").orderBy("i"), "bird_target_enc") == pytest.approx(want)
    assert X.one_hot(df.where("bird IS NOT NULL").select("bird"), ["bird"]).columns == ["bird_heron", "bird_owl", "bird_wren"]
    with pytest.raises(ValueError):
        X.one_hot(df, ["bird"], most=2)


def test_scaling_and_products(spark):
    df = spark.createDataFrame([(1, 4.0, 7.0), (2, 5.0, 7.0), (3, None, 7.0)], "A int, B double, K double")
    assert column(X.scale(df, ["A"]).orderBy("A"), "A") == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert column(X.scale(df, ["A", "K"], "minmax").orderBy("A"), "K") == [0, 0, 0]
    assert column(X.combine(df, ["A", "B"]).orderBy("A"), "A * B") == [4, 10, 3]
    assert X.polynomial(df, ["A", "B"], bias=True).columns == ["A", "B", "K", "1", "A^2", "A B", "B^2"]


def test_correlation(spark):
    df = spark.createDataFrame([(float(i * i), float(i), -3.0 * i + 2, 4.5) for i in range(-1, 7)], "bowl double, line double, fall double, level double")
    chosen = {r.column: r.r for r in M.correlation_select(df, "line", 0.5).collect()}
    assert chosen == pytest.approx({"fall": -1.0, "bowl": np.corrcoef([i * i for i in range(-1, 7)], range(8))[0, 1]})
    assert {r.column: round(r.r, 6) for r in M.correlation_select(df, "line", 0.99, method="kendall").collect()} == {"fall": -1.0}
    assert {r["column"]: r.variance for r in M.variance_select(df.select("line", "level"), 0.1).collect()} == {"line": 5.25}
    assert all(math.isinf(r.vif) for r in M.vif(df).collect())
    assert [r.rho for r in M.spearman_table(df, ["fall", "level"]).collect()] == [None]
    assert M.correlation_select(df, "line", columns=["line"], method="spearman").count() == 0
    with pytest.raises(ValueError):
        M.correlation_select(df, "line", method="guess")
    tied = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (None,)], "x double")
    assert {r.value: r.rank for r in M.average_ranks(tied, "x").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_empty_and_tiny_tables(spark, gauges):
    none = gauges.where("reading < 0")
    for f in (C.overall_missing_rate, C.row_completeness, D.skewness_profile, D.scale_profile, D.normality, D.cardinality_profile, D.imbalance_profile, D.rare_categories, D.sparsity, D.samples_per_feature, O.outlier_summary, O.uniqueness_violations):
        assert f(none).count() == 1, f.__name__
        assert f(gauges).count() == 1, f.__name__
    assert D.uncertainty(gauges, "wind").first()[0] == 0.5
    assert D.cardinality_distribution(gauges).first().shape == "unknown"


def test_peaks(spark):
    two = spark.range(2000).select((F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0) * F.when(F.col("id") % 200 < 2, 12.0).otherwise(5 + (F.col("id") % 100) / 100)).alias("x"), ((F.col("id") % 1000) / 1000).alias("flat"))
    assert D.multimodality(two).first()[0] == 0.5


def test_interpolation(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, None), (4, None), (5, 4.0), (6, None)], "n int, x double")
    assert column(C.interpolate(df, ["x"], "n").orderBy("n"), "x") == [1, 1, 2, 3, 4, 4]


def test_labels(spark):
    one = spark.range(1)
    got = one.select(L.make_label(F.lit("myCamelCase_table-1.csv")).alias("l"), L.quote(F.lit("a b~*/ç")).alias("q"), L.expand_ranges(F.array(*map(F.lit, ["s1-s3", "s5-s6", "s8", "x"]))).alias("r"), L.library_prefixes(F.lit("a.b.c")).alias("p"), L.library_of(F.lit("builtin.x")).alias("lib"), L.chunks(F.lit("abcdefghij"), 4, 0.25).alias("c")).first()
    assert got.l == "my camel case table 1" and got.q == "a+b~%2A%2F%C3%A7"
    assert got.r == ["s1", "s2", "s3", "s5", "s6", "s8", "x"] and got.p == ["a", "a.b", "a.b.c"] and got.lib is None
    assert got.c == ["abcd", "defg", "ghij", "j"]


def test_catalog(spark):
    a = spark.createDataFrame([(1, 2.0, True), (2, 3.0, False)], "customer_id int, price double, paid boolean")
    b = spark.createDataFrame([(1, 2.0, False), (2, 3.0, False)], "customerId int, cost double, paid boolean")
    tables = {"a": a, "b": b}
    columns = K.profile_lake(tables, "src", "set").join(K.content_vectors(tables, "src", "set"), "column_id", "left").cache()
    label = {(r.column_id_1.split("/")[-1], r.column_id_2.split("/")[-1]) for r in K.label_similarity(columns).collect()}
    assert label == {("customer_id", "customerId"), ("paid", "paid")}
    content = K.content_similarity(columns)
    assert ("price", "cost") in {(r.column_id_1.split("/")[-1], r.column_id_2.split("/")[-1]) for r in content.collect()}
    assert K.boolean_similarity(columns).count() == 0
    assert {tuple(r) for r in K.related_tables(content, columns, None, 3, "content").select("table_id", "related_table_id").collect()} == {("src/set/a", "src/set/b"), ("src/set/b", "src/set/a")}
    assert K.join_paths(content, columns, "src/set/a", "src/set/a", 2).count() == 4
    assert K.descendants(K.membership_triples(columns), "src/set").count() == 8


def test_triples(spark):
    rows = [("a", "p", "b", "iri", None), ("a", "p", 'x "y"\n', "text", None), ("a", "p", "1.23456", "number", 0.5), ("a", "p", "NaN", "number", None)]
    lines = column(S.triple_lines(spark.createDataFrame(rows, "s string, p string, o string, o_type string, certainty double")), "line")
    assert lines == ["<a> <p> <b> .", '<a> <p> "x \\"y\\"\\n" .', "<a> <p> 1.235 .", "<< <a> <p> 1.235 >> <withCertainty> 0.5 .", '<a> <p> "NaN"^^<http://www.w3.org/2001/XMLSchema#double> .']


def test_case_files(spark, tmp_path):
    for p, text in (("one/case/a.csv", "x,y\n1,?\n2,b\n"), ("one/other/b.csv", "x\n1\n"), ("two/deep/c.csv", "x\n1.5\n"), ("two/empty.csv", "")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    found = {(r.case, r.path.rpartition("/")[2]) for r in S.list_case_tables(spark, str(tmp_path)).collect()}
    assert found == {("one", "a.csv"), ("two", "c.csv")}
    table = S.read_table(spark, str(tmp_path / "one/case/a.csv"))
    assert table.dtypes == [("x", "bigint"), ("y", "string")] and column(table, "y") == [None, "b"]
    (tmp_path / "t.txt").write_bytes("é".encode("latin-1"))
    assert S.read_case_text(spark, [str(tmp_path / "t.txt")]).first().text == "é"


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "id int, v string")
    assert sorted(map(tuple, S.upsert_vectors(new, old).collect())) == [(1, "a"), (2, "c")]


def test_pipelines(spark):
    calls = spark.createDataFrame([(1, "a.x.f"), (1, "b.y"), (2, "a.x.f"), (3, "builtin.print")], "pipeline_id int, component string")
    assert [(r.library, r.n_pipelines) for r in P.library_usage(calls, 5).collect()] == [("a", 2), ("b", 1)]
    assert column(P.pipelines_calling(calls, ["a.x.f", "b.y"]), "pipeline_id") == [1]
    statements = spark.createDataFrame([(1, i, p, f"t{i}") for i, p in enumerate("aabba")], "pipeline_id int, n int, phase string, text string")
    assert [(r.phase, r.first_n, r.size) for r in P.phase_blocks(statements).orderBy("block").collect()] == [("a", 0, 2), ("b", 2, 2), ("a", 4, 1)]
    code = spark.createDataFrame([(1, "import os.path\nfrom a.b import c\n")], "id int, text string")
    assert sorted(column(P.import_edges(code, "id", "text"), "library")) == ["a", "a.b", "a.b.c", "os", "os.path"]


def test_ranking(spark):
    columns = spark.createDataFrame([("c1", "t1", "x", "int", [1.0, 0.0], [1.0, 0.0]), ("c2", "t2", "y", "float", [1.0, 0.0], [0.0, 1.0]), ("c2", "t2", "z", "string", [1.0, 0.0], [1.0, 0.0])], "case_id string, table_id string, column_id string, data_type string, label array<double>, content array<double>")
    pairs = spark.createDataFrame([("c1", "c2")], "case_id string, candidate_id string")
    matches = V.column_matches(pairs, columns)
    assert [r.score for r in matches.collect()] == [0.4]
    names = spark.createDataFrame([("t1", [1.0]), ("t2", [1.0])], "table_id string, vector array<double>")
    tables = V.table_matches(matches, names)
    assert [r.score for r in tables.collect()] == [0.46]
    semantic = pairs.withColumn("score", F.lit(0.5))
    assert V.case_similarity(tables, semantic, semantic).first().total == 0.489
    plan = spark.createDataFrame([(1, "STEP 1 Competition[a] -> Pipeline[b] -> Insight[c]\nSTEP 2 none")], "id int, text string")
    assert [tuple(r) for r in V.plan_references(plan, "id", "text").collect()] == [(1, 1, "a", "b", "c")]


def plain_tree(x, y, depth):
    """Importances of a regression tree that tries every split, ties to the first column."""
    gains = np.zeros(x.shape[1])

    def grow(rows, left):
        best = (1e-12, None, None)
        whole = rows.sum() * y[rows].var()
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[:-1]:
                a, b = rows & (x[:, j] <= cut), rows & (x[:, j] > cut)
                gain = whole - a.sum() * y[a].var() - b.sum() * y[b].var()
                if gain > best[0] + 1e-9:
                    best = (gain, j, (a, b))
        if left and best[1] is not None:
            gains[best[1]] += best[0]
            for part in best[2]:
                grow(part, left - 1)

    grow(np.ones(len(y), bool), depth)
    return gains / gains.sum() if gains.sum() else gains


def test_importances_of_indicators(spark):
    rng = np.random.default_rng(5)
    n = 240
    c, d, x = rng.integers(0, 5, n), rng.integers(0, 3, n), rng.integers(0, 9, n).astype(float)
    y = 7.0 * (c == 3) + 2.0 * (d == 2) + 0.3 * x + rng.random(n)
    rows = [(None if i % 11 == 0 else float(x[i]), None if i % 13 == 0 else "abcde"[c[i]], "pqr"[d[i]], "same", None, float(y[i])) for i in range(n)] + [(1.0, "a", "p", "same", None, None)]
    df = spark.createDataFrame(rows, "x double, `c.1` string, d string, one string, none string, y double")
    known = [r[0] for r in rows[:n] if r[0] is not None]
    wide = np.column_stack([[float(np.mean(known)) if r[0] is None else r[0] for r in rows[:n]], *[[r[1] == v for r in rows[:n]] for v in "bcde"], *[[r[2] == v for r in rows[:n]] for v in "qr"]]).astype(float)
    got = G.encoded_importances(df, "y", ["x"], ["c.1", "d", "one", "none"], depth=4).collect()
    assert [(r.column, r.feature) for r in got] == [("x", 0), *[("c.1", i) for i in range(4)], *[("d", i) for i in range(2)]]
    assert np.allclose([r.importance for r in got], plain_tree(wide, y, 4), atol=1e-9)
    clash = df.withColumnsRenamed({"x": "label", "c.1": "m0", "d": "features"})
    assert [r.importance for r in G.encoded_importances(clash, "y", ["label"], ["m0", "features"], depth=4).collect()] == [r.importance for r in got]
    assert G.encoded_importances(df.limit(0), "y", ["x"], ["d"]).count() == 0 and G.encoded_importances(df, "y", [], ["one"]).count() == 0
    classes = df.withColumn("t", F.when(F.col("d") == "r", "yes").otherwise("no"))
    assert {r.column: r.importance for r in G.encoded_importances(classes, "t", ["x"], ["d"]).groupBy("column").agg(F.sum("importance").alias("importance")).collect()} == {"x": 0.0, "d": 1.0}
    assert G.synergy(df.limit(19), "y", ["x"], ["d"]).first()[0] == 0.3 and 0 <= G.synergy(df, "y", ["x"], ["d"]).first()[0] < 1
    texts = df.withColumn("t", F.concat(F.col("x").cast("string"), "d", F.col("`c.1`")))
    assert G.synergy(texts, "t", ["x"], ["d"]).first()[0] == 0.3  # a text of many values is no target


def test_forest_over_cells_of_equal_features(spark, monkeypatch):
    """A forest over many rows of few distinct features never grows over the rows; its trees draw each row as often as a bootstrap does."""
    cell = (F.xxhash64("id") % 5 + 4).cast("double")
    df = spark.range(0, 6000, 1, 3).select(F.when(F.col("id") % 50 > 0, cell).alias("x"), F.when(F.col("id") % 7 > 0, F.substring(F.lit("abc"), (F.col("id") % 3 + 1).cast("int"), F.lit(1))).alias("c"), (cell * cell + F.col("id") % 3 + F.rand(1)).alias("y"))
    classes = df.withColumn("y", F.when(F.col("y") > 20, "yes").otherwise("no"))
    plain = [[r.importance for r in G.encoded_importances(t, "y", ["x"], ["c"], 16).collect()] for t in (df, classes)]
    rows = df.select(F.col("y").alias("label"), F.coalesce("x", F.lit(4.0)).alias("n0"), F.col("c").alias("c0"))
    counts = rows.groupBy("n0", "c0").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("sum"))
    cells = counts.withColumn("cell", F.row_number().over(Window.orderBy("n0", "c0")) - 1)
    found = G._drawn(rows, cells, cells.count(), ["n0", "c0"], 200, 7).collect()
    assert len(found) == cells.count() and any(r.c0 is None for r in found)
    for r in found:
        drawn = np.array(r.drawn[:200])
        assert abs(drawn.mean() - r.rows) < 5 * (r.rows / 200) ** 0.5 and 0.6 < drawn.var() / r.rows < 1.6
        assert sum(r.drawn[200:]) / drawn.sum() == pytest.approx(r.sum / r.rows, rel=0.05)
    with monkeypatch.context() as m:
        m.setattr(G, "FEW_ROWS", 0)
        m.setattr(G, "MOST_SUMS", 1)  # too many cells: over the rows, as before
        assert [r.importance for r in G.encoded_importances(df, "y", ["x"], ["c"], 16).collect()] == plain[0]
    monkeypatch.setattr(G, "FEW_ROWS", 0)
    monkeypatch.setattr(G, "_grown", None)
    for t, want in zip((df, classes), plain, strict=True):
        got = [r.importance for r in G.encoded_importances(t, "y", ["x"], ["c"], 16).collect()]
        assert sum(got) == pytest.approx(1) and got == pytest.approx(want, abs=0.3)  # a node tries one of the three features


def test_interaction_effects(spark):
    rows = [(float(i // 2), float(i % 2), i + r / 100) for r in range(5) for i in range(4)]  # over ten values, so no classes
    even = spark.createDataFrame(rows, "a double, b double, y double")
    low = plain_tree(np.array([r[:2] for r in rows]), np.array([r[2] for r in rows]), 5).min()
    assert G.interaction_effects(even, "y", ["a", "b"]).first()[0] == pytest.approx(1 - ((0.5 - low) / 2) / 0.5, abs=2e-4)
    assert G.interaction_effects(even, "y", ["a"]).first()[0] == 0.0


def test_high_cardinality_impact(spark):
    df = spark.range(200).select((F.col("id") % 40).cast("string").alias("wide"), (F.col("id") % 3).cast("string").alias("narrow"), F.col("id").cast("double").alias("y"), F.lit(1).alias("same"), F.col("id").cast("string").alias("t"))
    assert tuple(G.high_cardinality_impact(df, "y", ["wide", "narrow"]).first()) == (0.5, 0.25)
    assert tuple(G.high_cardinality_impact(df, "same", ["wide"]).first()) == (1.0, 0.0)
    assert tuple(G.high_cardinality_impact(df, "t", ["wide"]).first()) == (1.0, 0.3)
    assert tuple(G.high_cardinality_impact(df, "y", ["narrow"]).first()) == (0.0, 0.3)
    assert tuple(G.high_cardinality_impact(df, "y", []).first()) == (0.0, 0.0)
    assert tuple(G.high_cardinality_impact(df.limit(0), "y", ["wide"]).first()) == (0.0, 0.3)


def test_high_cardinality_impact_grows_no_tree(spark, monkeypatch):
    monkeypatch.setattr(G, "_grown", None)
    df = spark.range(300).select(F.when(F.col("id") % 50 > 0, F.col("id") % 50).alias("wide"), (F.col("id") % 50 == 0).cast("double").alias("y"), F.when(F.col("id") % 100 < 50, "a").otherwise("b").alias("k"), F.when(F.col("id") == 7, 1.0).alias("few"))
    assert tuple(G.high_cardinality_impact(df, "y", ["wide"]).first()) == (1.0, round(10 / 49, 4))  # only missing cells have another label
    assert tuple(G.high_cardinality_impact(df, "k", ["wide"]).first()) == (1.0, 0.0)  # each value has as many of each class
    assert tuple(G.high_cardinality_impact(df, "few", ["wide"]).first()) == (1.0, 0.0)


def test_regression_f_with_gaps(spark):
    rows = [(None, 1.0), (1.0, 2.0), (2.0, 2.5), (3.0, 4.5), (5.0, 4.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    x, y = np.array([2.75, 1, 2, 3, 5]), np.array([r[1] for r in rows])
    r = np.corrcoef(x, y)[0, 1]
    assert G.regression_f(df, "y", ["x"]).first().score == pytest.approx(r * r / (1 - r * r) * 3)
    gaps = df.union(spark.createDataFrame([(9.0, None)], "x double, y double")).withColumn("same", F.lit(1.0))
    got = {s.column: s.score for s in G.regression_f(gaps, "y", ["x", "same"]).collect()}
    assert got == {"x": pytest.approx(abs(np.corrcoef(x[1:], y[1:])[0, 1])), "same": 0.0}


def test_series_diversity_and_counts(spark):
    wave = spark.range(120).select(F.timestamp_seconds("id").alias("at"), F.sin(F.col("id") * math.pi / 5).alias("a"), (F.col("id") % 7).alias("b"), F.lit("x").alias("s"))
    got = Z.time_series_properties(wave).first()
    each = [(Z.stationarity(wave, "at", c, "at").first()[0], Z.periodicity(wave, "at", c, "at").first()[0]) for c in "ab"]
    assert got.is_time_series and (got.stationarity_strength, got.periodicity_strength) == pytest.approx(tuple(np.mean(each, axis=0)), abs=1e-4)
    assert tuple(Z.time_series_properties(wave.select("a")).first()) == (False, 0.0, 0.0) == tuple(Z.time_series_properties(wave, "nothing").first())
    assert tuple(Z.time_series_properties(wave.select("at", "s")).first()) == (True, 0.0, 0.0)
    few = spark.createDataFrame([(i, "a", None if i else "z") for i in range(6)], "id int, same string, none string")
    assert D.uncertainty(few).first()[0] == D.uncertainty(few, "gone").first()[0] == 0.5833
    assert D.uncertainty(few.limit(0)).first()[0] == 0.1 and D.uncertainty(few.limit(2)).first()[0] == 0.5
    empty = G.dataset_complexity(few.limit(0), "same").first()
    assert (empty.noise_level.signal_to_noise, empty.noise_level.uncertainty, empty.dimensionality.samples_per_feature) == (2.5, 0.1, 0.0)
    columns = spark.createDataFrame([("a/t/x", "a/t", "a"), ("a/t/y", "a/t", "a"), ("b/u/x", "b/u", "b")], "column_id string, table_id string, dataset_id string")
    pipelines = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, None)], "pipeline_id int, dataset_id string")
    assert tuple(K.graph_info(columns, pipelines).first()) == (2, 2, 2, 3) and tuple(K.graph_info(columns.limit(0), pipelines).first()) == (0, 0, 0, 0)


def test_tool_states(spark):
    """Empty insights, nulls, tools without paths, paths twice and inner objects."""
    values = [(1, "q.gaps.rate", "0.5"), (1, "q.gaps.kind", "unknown"), (1, "q.odd", "unknown"), (1, "deep.a.b", "unknown"), (1, "flat.x", None), (1, "none", None), (2, "q.odd", "3"), (None, "q.odd", "3")]
    fields = spark.createDataFrame(values, "case_id int, path string, value string")
    tools = spark.createDataFrame([("gaps", "q.gaps"), ("gaps", "q.odd"), ("gaps", "q.odd"), ("odd", "q.odd"), ("deep", "deep"), ("flat", "flat"), ("none", "none")], "tool string, path string")
    asked = spark.createDataFrame([(1, t) for t in ("gaps", "gaps", "odd", "deep", "flat", "none", "own")] + [(2, "odd"), (3, "gaps")], "case_id int, tool string")
    states = V.tool_states(fields, asked, tools)
    assert {(r.case_id, r.tool): (r.state, r.n_fields, r.n_extracted, r.missing_fields) for r in states.collect()} == {
        (1, "gaps"): ("partial", 2, 1, ["q.odd"]), (1, "odd"): ("missing", 1, 0, ["q.odd"]), (1, "deep"): ("complete", 1, 1, []), (1, "flat"): ("complete", 1, 1, []),
        (1, "none"): ("missing", 1, 0, ["none"]), (1, "own"): ("no_mapping", 0, 0, []), (2, "odd"): ("complete", 1, 1, []), (3, "gaps"): ("missing", 2, 0, ["q.gaps", "q.odd"]),
    }
    # q, q.gaps, its two, q.odd, deep, deep.a, deep.a.b, flat, flat.x, none: 11 fields, 3 of them unknown
    report = {r.case_id: tuple(r)[1:] for r in V.completeness_report(fields, states).collect()}
    assert report[1] == (3.6, 3, 11, ["no output of: none, odd", "part of the output of: gaps"]) and report[2] == (5.0, 0, 2, [])
    poor = V.completeness_report(fields.where("value = 'unknown'").where("path = 'q.odd'"), states)
    assert poor.first().score == 2.5 and poor.first().warnings[0] == "low completeness: 50.0%"
    assert V.tool_states(fields.limit(0), asked.limit(0), tools).count() == 0 and V.completeness_report(fields.limit(0), states).count() == 0


def test_field_similarity_of_structures(spark):
    rows = [
        ("missing_pattern", "MAR", "MCAR", 0.7), ("missing_pattern", "MNAR", "MAR", 0.5), ("missing_pattern", "MNAR", "MCAR", 0.0), ("missing_pattern", "X", "X", 0.0), ("missing_pattern", "unknown", "MAR", 0.0),
        ("missing_pattern", None, "MAR", None), ("distribution", "balanced", "uniform", 0.6), ("distribution", "power_law", "uniform", 0.0), ("distribution", "odd", "odd", 1.0),
        ("vector", '{"a": 3, "b": 4}', '{"b": 4, "a": 3}', 1.0), ("vector", '{"a": 1}', '{"a": 3, "c": 4}', 0.6), ("vector", '{"a": null}', '{"a": 1}', 0.0), ("vector", "[3, 4]", "[4, 3]", 0.96), ("vector", "[1]", "[1, 2]", 0.0),
        ("vector", "[1]", '{"a": 1}', 0.0), ("vector", "{}", "{}", 0.0), ("vector", "text", "text", 0.0), ("vector", "unknown", "unknown", 1.0), ("vector", None, "[1]", 0.0), ("float", "0", "0.0", 1.0), ("float", "2", "-2", 0.0),
        ("float", "NaN", "1", 0.0), ("int", "x", "1", 0.0), ("boolean", "True", "true", 1.0), ("string", None, "a", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, a string, b string, want double")
    got = df.select("i", F.bround(V.field_similarity(F.col("kind"), F.col("a"), F.col("b")), 9).alias("s")).orderBy("i").collect()
    assert [(rows[r.i], r.s) for r in got] == [(r, r[3]) for r in rows]


def test_visible_fields(spark):
    names = [("pre_eda", "data_quality"), ("pre_eda", "other"), ("deep_eda", "complexity"), ("deep_eda", "feature_importance"), ("else", "data_quality"), (None, None)]
    fields = spark.createDataFrame([(1, *n) for n in names], "case_id int, section string, module string")
    seen = lambda phase: {r.module for r in V.visible_fields(fields, spark.createDataFrame([(1, phase), (1, phase), (2, phase)], "case_id int, phase string")).collect()}
    assert seen("Data Cleaning") == seen("Preliminary Exploratory Data Analysis") == {"data_quality"}
    assert seen(" In-depth Exploratory Data Analysis ") == {"data_quality", "other", "complexity"}
    assert seen("Feature Engineering") == {"data_quality", "other", "complexity", "feature_importance"}
    assert seen(None) == seen("Reporting") == {"data_quality", "other"}


def test_phases_of_checks(spark):
    cases = spark.createDataFrame([("a", "Data Cleaning"), ("b", "Feature Engineering"), ("c", "Reporting"), ("d", None)], "case string, phase string")
    tables = spark.createDataFrame([("a", "cleaned_train"), ("a", "cleaned_train"), ("b", "processed_train"), ("b", "processed_test")], "case string, table_name string")
    assert {r.subject: (r.passed, r.detail) for r in A.phase_tables(cases, tables).collect()} == {"a": (False, "cleaned_test"), "b": (True, ""), "c": (True, ""), "d": (True, "")}
    assert {r.subject: r.detail for r in A.phase_tables(cases, tables, base=True).collect()}["c"] == "overview,sample_submission,test,train"
    asked = []

    def later():
        asked.append(1)
        return A.no_duplicate_rows(tables, "tables")

    of = lambda case: {"required_tables": lambda: A.phase_tables(cases.where(F.col("case") == case), tables), "later": later}
    suites = {"p": ["required_tables", "unknown", "later"]}
    assert [(r.check, r.passed) for r in A.run_phase("p", suites, of("a")).collect()] == [("required_tables", False)] and not asked
    assert [(r.check, r.detail) for r in A.run_phase("p", suites, of("b")).collect()] == [("no_duplicate_rows", "1")] and asked
    assert A.run_phase("none", suites, of("b")).collect() == []


def test_blocks_and_imports(spark):
    turns = [(1, n, p, f"{n}" * 300) for n, p in ((0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "a"), (6, "a"), (7, None), (8, None))]
    blocks = P.phase_blocks(spark.createDataFrame(turns, "pipeline_id int, n int, phase string, text string")).orderBy("block").collect()
    assert [(r.block, r.phase, r.statements, r["size"], [s.n for s in r.snippets]) for r in blocks] == [(1, "a", "s0-s4", 5, [0, 1, 3, 4]), (2, "a", "s6", 1, [6]), (3, None, "s7-s8", 2, [7, 8])]
    assert blocks[0].snippets[0].text == "0" * 200
    code = "import os, numpy as np; import re\nfrom a.b import (c,  # d\n  e as f,\n)\nfrom g import *\nfrom . import h\nfrom .i import j\nif x:\n    import k.l\nfrom m \\\n  import n\nimportant = 1\n# import no\nimport 3x, o-p\n"
    found = P.import_edges(spark.createDataFrame([(1, code), (2, None), (3, "")], "id int, source string"), "id", "source")
    assert sorted(column(found, "library")) == ["a", "a.b", "a.b.c", "a.b.e", "g", "k", "k.l", "m", "m.n", "numpy", "os", "re"]


def test_time(spark):
    wave = spark.range(200).select("id", F.sin(F.col("id") * math.pi / 5).alias("x"))
    assert Z.periodicity(wave, "id", "x", "id").first()[0] > 0.9
    assert Z.stationarity(spark.range(300).select("id", F.rand(3).alias("x")), "id", "x", "id").first()[0] > 0.95
    assert Z.periodicity(wave.limit(10), "id", "x", "id").first()[0] == 0.0


def test_assertions(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, v string")
    checks = A.run_checks(A.no_duplicate_rows(df, "t"), A.no_missing_values(df, "t"), A.consecutive_ids(df, "id", "t"), A.same_ids(df.select("id"), df.select("id"), "t"))
    assert {(r.check, r.subject): r.passed for r in checks.collect()} == {("no_duplicate_rows", "t"): False, ("no_missing_values", "t.id"): True, ("no_missing_values", "t.v"): False, ("consecutive_ids", "t"): False, ("same_ids", "t"): True}
    columns = spark.createDataFrame([("train", 0, "ID"), ("train", 1, "x"), ("train", 2, "y"), ("test", 0, "ID"), ("test", 1, "x"), ("bad", 0, "x"), ("bad", 1, "x")], "table_name string, position int, column_name string")
    assert column(A.target_columns(columns, "train", "test"), "column_name") == ["y"]
    assert {r.subject: r.passed for r in A.has_id_column(columns, ["id"]).collect()} == {"train": True, "test": True, "bad": False}
    assert {r.subject: r.passed for r in A.no_duplicate_columns(columns).collect()} == {"train": True, "test": True, "bad": False}
    assert A.same_columns(columns, "train", "test").first().passed is False


def test_runs_of_a_series(spark):
    """Runs of few rows give the lags and the interpolation that the whole series gives."""
    x = [None if i % 5 in (0, 1) or 20 <= i < 33 else float(i * i % 37) for i in range(60)]
    df = spark.createDataFrame([((i * 7) % 60, x[(i * 7) % 60]) for i in range(60)], "n int, x double")
    got = column(C.interpolate(df, ["x"], "n", run=4).orderBy("n"), "x")
    known = [i for i in range(60) if x[i] is not None]
    assert np.allclose(got, np.interp(range(60), known, [x[i] for i in known]))
    rows = df.where("x IS NOT NULL").select(F.col("n").alias("_time"), F.lit(0).alias("_tie"), "x")
    lagged = {tuple(r) for r in Z.lags(rows, [], 3, run=3).collect()}
    v = [x[i] for i in known]
    assert lagged == {(v[i], *[v[i - k] if i >= k else None for k in (1, 2, 3)]) for i in range(len(v))}


def test_impute_nearest_in_blocks(spark):
    """Blocks of few rows give what comparing all rows gives; a row without known cells keeps its gaps."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 9, (70, 3)).astype(float)
    a[rng.random(a.shape) < 0.3] = np.nan
    a[5] = np.nan
    cells = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(a)]
    df = spark.createDataFrame(cells, "id int, a double, b double, c double")
    want = [list(r[1:]) for r in cells]
    for i, j in zip(*np.where(np.isnan(a)), strict=True):
        near = []
        for d in range(len(a)):
            both = ~np.isnan(a[i]) & ~np.isnan(a[d])
            if not np.isnan(a[d, j]) and both.any():
                near.append((((a[i] - a[d])[both] ** 2).sum() * (3 / both.sum()), d))
        want[i][j] = np.mean([a[d, j] for _, d in sorted(near)[:5]]) if near else None
    got = [list(r)[1:] for r in C.impute_nearest(df, ["a", "b", "c"], "id", rows=16).orderBy("id").collect()]
    assert got[5] == [None, None, None]
    assert np.allclose(np.array(got, dtype=float), np.array(want, dtype=float), equal_nan=True)
    whole = spark.createDataFrame([(1, 2.0)], "id int, a double")
    assert C.impute_nearest(whole, ["a"], "id").collect() == whole.collect() and C.impute_nearest(whole.limit(0), ["a"], "id").count() == 0


def test_scales_and_text_vectors(spark):
    columns = spark.createDataFrame([("x", "t", "int", [0.0], 0.0), ("y", "u", "int", [0.1], 0.1), ("z", "v", "int", [0.1], 0.3)], "column_id string, table_id string, data_type string, embedding array<double>, s double")
    assert {(r.column_id_1, r.column_id_2) for r in K.content_similarity(columns, scale="s").collect()} == {("x", "y")}
    assert K.content_similarity(columns).count() == 3
    words = spark.createDataFrame([("red", [1.0, -4.0]), ("hat", [3.0, 0.0])], "word string, vector array<double>")
    texts = spark.createDataFrame([(1, "Red, red hat"), (2, "nothing"), (3, None)], "id int, text string")
    assert [(r.id, [round(v, 3) for v in r.vector], round(r.scale, 3)) for r in K.text_vectors(texts, words).collect()] == [(1, [1.667, -2.667], 2.667)]
    assert K.text_vectors(texts, words.limit(0)).count() == 0


def test_turtle_blocks(spark):
    """Objects in order, texts escaped, repeats and nulls left out; a large subject in several blocks that say the same."""
    rows = [("a", "p", "y", "iri"), ("a", "p", "x", "iri"), ("a", "p", "x", "iri"), ("a", "q", 'say "no"', "text"), ("a", "q", None, "text"), ("b", "n", "2.00049", "number")]
    triples = spark.createDataFrame(rows, "s string, p string, o string, o_type string")
    assert {r.block for r in S.turtle_blocks(triples).collect()} == {'<a> <p> <x>, <y> ;\n\t<q> "say \\"no\\"" .', "<b> <n> 2.0 ."}
    many = spark.range(200).select(F.lit("s").alias("s"), F.lit("p").alias("p"), F.col("id").cast("string").alias("o"), F.lit("iri").alias("o_type"))
    blocks = [r.block for r in S.turtle_blocks(many, most=20).collect()]
    assert len(blocks) > 5 and sorted(o for b in blocks for o in b[len("<s> <p> ") : -2].split(", ")) == sorted(f"<{i}>" for i in range(200))
    assert S.turtle_blocks(triples.limit(0)).count() == 0


def test_turtle_blocks_of_small_subjects_meet_once(spark):
    """Triples of small subjects are neither counted when distinct nor joined; large subjects are split by their distinct triples beside them."""
    small = spark.createDataFrame([("a", "q", "1", "iri"), ("a", "p", "y", "iri"), ("a", "p z", "x", "iri"), ("a", "p", "x", "iri"), ("b", "p", "x", "iri")], "s string, p string, o string, o_type string")
    got = S.turtle_blocks(small, most=4)
    assert {r.block for r in got.collect()} == {"<a> <p z> <x> ;\n\t<p> <x>, <y> ;\n\t<q> <1> .", "<b> <p> <x> ."}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    repeated = small.union(small)  # 8 rows of <a>, but 4 distinct ones: one block
    many = spark.range(100).select(F.lit("c"), F.concat(F.lit("p"), F.col("id") % 3), F.col("id").cast("string"), F.lit("iri"))
    blocks = sorted(r.block for r in S.turtle_blocks(repeated.union(many), most=4).collect())
    assert blocks[:2] == sorted(r.block for r in got.collect()) and len(blocks) > 12
    said = sorted((p.split("> ")[0][1:], o) for b in blocks[2:] for p in b[len("<c> ") : -2].split(" ;\n\t") for o in p.split("> ", 1)[1].split(", "))
    assert said == sorted((f"p{i % 3}", f"<{i}>") for i in range(100))


def test_unit_root_statistic(spark):
    """The regression over lags in runs equals plain least squares."""
    x = np.cumsum(np.random.default_rng(5).normal(size=400)) * 0.3 + np.random.default_rng(6).normal(size=400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, x double")
    dy = np.diff(x)
    design = np.column_stack([np.ones(398), x[1:-1], dy[:-1]])
    beta, rss = np.linalg.lstsq(design, dy[1:], rcond=None)[:2]
    tau = beta[1] / math.sqrt(rss[0] / (398 - 3) * np.linalg.inv(design.T @ design)[1, 1])
    assert Z.stationarity(df, "t", "x", "t").first()[0] == pytest.approx(1 - Z.unit_root_p(tau), abs=1e-3)


def plain_tau(pairs):
    sign = lambda a, b: (a > b) - (a < b)
    found = [(sign(a, c), sign(b, d)) for i, (a, b) in enumerate(pairs) for c, d in pairs[:i]]
    n, same_x, same_y = len(found), sum(x == 0 for x, _ in found), sum(y == 0 for _, y in found)
    under = math.sqrt(n - same_x) * math.sqrt(n - same_y)
    return sum(x * y for x, y in found) / under if under else None


@pytest.mark.parametrize(("a", "b"), [(3, 3), (200, 4), (1000, 1000), (1, 5)])
def test_kendall_equals_all_pairs(spark, a, b):
    rng = random.Random(a)
    pairs = [(float(rng.randrange(a)), float(rng.randrange(b))) for _ in range(120)]
    df = spark.createDataFrame([*pairs, (None, 1.0), (2.0, float("nan"))], "x double, y double")
    for blocks, least in ((1000, 1 << 16), (6, 1), (50, 1)):
        got = M.kendall_pair(df, "x", "y", blocks, least).first().tau
        assert got == (None if plain_tau(pairs) is None else pytest.approx(plain_tau(pairs), abs=1e-12))


def test_correlation_selects_ranks_counted_pairs(spark, monkeypatch):
    """All methods at once give what each gives by rows; rank methods join distinct pairs, no rows."""
    df = spark.range(0, 3000, 1, 3).select((F.xxhash64("id") % 40).cast("double").alias("x"), F.when(F.col("id") % 9 > 0, F.xxhash64("id") % 40 + F.col("id") % 50).alias("y"), F.lit(1.0).alias("one"), (F.col("id") % 7).alias("t"))
    want = {("spearman", c): M.spearman_pair(df, c, "t").first().rho for c in ("x", "y", "one")} | {("kendall", c): M.kendall_pair(df, c, "t").first().tau for c in ("x", "y", "one")}
    assert want.pop(("spearman", "one")) is None and want.pop(("kendall", "one")) is None
    monkeypatch.setattr(M, "with_ranks", None)
    got = {(r.method, r.column): r.r for r in M.correlation_selects(df, "t", 0.0).collect()}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-12) and len(got) == 6


def test_ranks_are_those_of_one_sort(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 700).cast("double").alias("x"), (F.xxhash64("id", F.lit(1)) % 9).cast("double").alias("y"), F.when(F.col("id") % 5 > 0, F.col("id") % 83).alias("z"))
    rows = [(r.x, r.y) for r in df.collect()]
    rank = lambda v: {x: sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in set(v)}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.value: r.rank for r in M.average_ranks(df, "x").collect()}
        table = {(r.x, r.y): r.rho for r in M.spearman_table(df).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = rank([x for x, _ in rows])
    assert got == want
    ry = rank([y for _, y in rows])
    assert table["x", "y"] == pytest.approx(np.corrcoef([want[x] for x, _ in rows], [ry[y] for _, y in rows])[0, 1])
    some = [(r.x, r.z) for r in df.collect() if r.z is not None]
    rx, rz = rank([x for x, _ in some]), rank([z for _, z in some])
    assert table["x", "z"] == pytest.approx(np.corrcoef([rx[x] for x, _ in some], [rz[z] for _, z in some])[0, 1])


@pytest.mark.parametrize(("left", "accuracy"), [(20_000, 10_000), (5, 20), (2, 10)])
def test_quantiles_narrow_until_few_values_are_left(spark, left, accuracy):
    rng = random.Random(3)
    cells = [(float(rng.choice([rng.random(), rng.randrange(3), 5.0])), float(rng.randrange(2)), None, math.exp(50 * rng.random())) for _ in range(2000)]
    df = spark.createDataFrame(cells, "a double, b double, c double, d double")
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b", "c", "d"], fractions, accuracy, left)
    assert got["c"] == [None] * 5
    for i, c in ((0, "a"), (1, "b"), (3, "d")):
        assert got[c] == pytest.approx(np.quantile([r[i] for r in cells], fractions), rel=1e-9)


def test_modes_of_all_types(spark):
    rows = [("b", 2, 0.5, True), ("a", 2, 0.5, None), ("b", 1, None, True), ("a", 1, 0.25, False), (None, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "s string, i int, x double, t boolean").withColumn("none", F.lit(None).cast("int"))
    got = C.modes(df, df.columns).first()
    assert tuple(got) == ("a", 1, 0.5, True, None) and C.modes(df.limit(0), ["s", "i"]).first() == (None, None)
    assert C.impute_most_frequent(df).where("s = 'b' AND i = 1").first().x == 0.5


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    points = [(f"p{i}", f"g{i % 3}", (rng.normal(size=6) * rng.choice([0.05, 1.0])).tolist()) for i in range(500)] + [(f"q{i}", "g0", [0.0] * 6) for i in range(30)] + [("none", "g0", None), ("other", "g0", [0.0])]
    df = spark.createDataFrame(points, "id string, group string, vector array<double>").repartition(5)
    want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and len(a[2]) == len(b[2]) and math.dist(a[2], b[2]) <= 0.4}
    for pivots, home, guests in ((512, 4096, 16_384), (7, 11, 13), (1, 50, 60)):
        got = [(r.id_1, r.id_2) for r in near_pairs(df, 0.4, pivots, home, guests).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert near_pairs(df.limit(0), 0.4).count() == 0


def test_content_of_numbers_dates_and_texts(spark):
    import datetime
    import struct

    days = [datetime.datetime(2020, 1, 1 + i) for i in range(6)]
    a = spark.createDataFrame([(float(i) - 2.5, days[i], ["oak", "elm", "ash"][i % 3], True) for i in range(6)], "x double, day timestamp, tree string, t boolean")
    b = spark.createDataFrame([(float(i) - 2.5, days[i], ["elm", "oak", "ash"][i % 3], None) for i in range(6)], "y double, at timestamp, wood string, none string")
    got = {r.column_id: r.embedding for r in K.content_vectors({"a": a, "b": b}, "s", "d").collect()}
    bits = [int.from_bytes(struct.pack("<f", i - 2.5), "little") for i in range(6)]
    assert got["s/d/a/x"] == pytest.approx([np.mean([b >> k & 1 for b in bits]) for k in range(32)])
    assert "s/d/b/none" not in got and "s/d/a/t" not in got
    columns = K.lake_columns({"a": a, "b": b}, "s", "d").join(K.content_vectors({"a": a, "b": b}, "s", "d"), "column_id", "left")
    edges = {(r.column_id_1[4:], r.column_id_2[4:]): r.certainty for r in K.content_similarity(columns).collect()}
    assert edges == pytest.approx({("a/x", "b/y"): 1.0, ("a/day", "b/at"): 1.0, ("a/tree", "b/wood"): 1.0})


def plain_label_score(l1, l2, vectors):
    a, b = l1.split(" "), l2.split(" ")
    if l1 == l2:
        return 1.0
    x, y = ([w for w in a if w not in b], [w for w in b if w not in a]) if len(a) > 1 and len(b) > 1 else (a, b)
    if not x and not y:
        return 1.0
    x, y = (a, b) if not x or not y else (x, y)
    if any(w not in vectors for w in x + y):
        return 0.0
    unit = {w: np.array(v) / np.linalg.norm(v) for w, v in vectors.items()}
    return float(np.mean([unit[p] @ unit[q] for p in x for q in y]))


def test_word_labels_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 5))
    vectors = {w: (base[i % 4] + rng.normal(size=5) * 0.25).tolist() for i, w in enumerate(["id", "key", "name", "price", "number", "code", "title", "cost"])}
    names = ["id", "key", "user_id", "id_user", "user_key", "name", "title", "book_title", "name_title", "price", "unit_price", "unit_cost", "cost_unit", "mystery", "id_id", "", "order number", "code_order", "key_code"]
    rows = [(f"t{i % 4}/{n}/{i}", f"t{i % 4}", "ab"[i % 3 == 0], n) for i, n in enumerate(names * 2)]
    df = spark.createDataFrame(rows, "column_id string, table_id string, data_type string, column_name string")
    words = spark.createDataFrame([(w, v) for w, v in vectors.items() if w != "mystery"] + [("zero", [0.0] * 5)], "word string, vector array<double>")
    label = {r.column_name: r.l for r in df.select("column_name", L.make_label(F.col("column_name")).alias("l")).distinct().collect()}
    want = {}
    for c1, t1, d1, n1 in rows:
        for c2, t2, d2, n2 in rows:
            if c1 < c2 and t1 != t2 and d1 == d2 and (s := plain_label_score(label[n1], label[n2], vectors)) >= 0.75:
                want[c1, c2] = s
    assert {(r.column_id_1, r.column_id_2): r.certainty for r in K.word_label_similarity(df, words).collect()} == pytest.approx(want)


def test_joint_charts_take_each_column_once(spark):
    own = [("t", "a", "n", [1.0, 0.0]), ("t", "b", "n", [0.9, 0.1]), ("t", "c", "n", [0.0, 1.0]), ("t", "d", "s", [1.0, 1.0]), ("u", "a", "n", [1.0, 0.0])]
    library = [(1, "n", [1.0, 0.0]), (2, "n", [1.0, 0.05]), (3, "n", [1.0, 0.1]), (4, "s", [1.0, 0.0]), (5, "x", [1.0, 0.0])]
    drawn = [("two", 1, "bivariate", "scatter"), ("two", 2, "bivariate", "scatter"), ("typed", 1, "bivariate", "box"), ("typed", 5, "bivariate", "box"), *[("many", i, "multivariate", "line") for i in (1, 2, 3, 4)], ("few", 1, "multivariate", "line"), ("few", 5, "multivariate", "line"), *[("all", i, "multivariate", "heatmap") for i in (1, 2)], ("one", 1, "univariate", "bar")]
    got = K.recommend_joint_charts(
        spark.createDataFrame([("t", "a", 1), ("u", "a", 1), ("t", "b", 9)], "query_table string, main_column string, similar_id int"),
        spark.createDataFrame(drawn, "eda_id string, column_id int, analysis_type string, chart_type string"),
        spark.createDataFrame(library, "column_id int, data_type string, vector array<double>"),
        spark.createDataFrame(own, "query_table string, name string, data_type string, vector array<double>"),
    )
    assert {(r.query_table, r.eda_id, tuple(r.chart_columns)) for r in got.collect()} == {("t", "two", ("a", "b")), ("t", "many", ("a", "b", "c", "d")), ("t", "all", ()), ("u", "all", ())}


def test_cells_are_unpivoted_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a", [1]), (None, "b", [2]), (1, "a", None)], "n int, s string, l array<int>")
    cells = K._cells(df, 5)
    assert {r[0]: r[1] for r in cells.distinct().groupBy("column").count().collect()} == {"5": 1, "6": 2}
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "Generate" not in plan


def test_quantiles_estimate_distinct_values_only_where_a_bracket_is_large(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).alias("b"))
    want = {"a": [749.75, 1499.5], "b": [1.0, 3.0]}
    assert exact_quantiles(df, ["a", "b"], [0.25, 0.5], left=2) == want
    monkeypatch.setattr(F, "approx_count_distinct", None)
    assert exact_quantiles(df, ["a", "b"], [0.25, 0.5]) == want


def test_joint_charts_rank_only_what_can_be_used(spark, monkeypatch):
    """Names stand in several rows; three partners and the main column use up three names before the last one is taken, so four do."""
    kept = []
    monkeypatch.setattr(K, "top_pairs", lambda q, r, k: kept.append(k) or top_pairs(q, r, k))
    own = [("t", f"c{i}", "n", [1.0, i / 10]) for i in range(8)] + [("t", "c0", "n", [1.0, 0.0])] * 3 + [("t", "z", "n", [0.0, 0.0]), ("t", None, "n", [1.0, 0.0]), ("t", "a", "n", [1.0]), ("t", "b", "n", [1.0, None])]
    got = K.recommend_joint_charts(
        spark.createDataFrame([("t", "c1", 1)], "query_table string, main_column string, similar_id int"),
        spark.createDataFrame([("many", i, "multivariate", "line") for i in (1, 2, 3, 4)], "eda_id string, column_id int, analysis_type string, chart_type string"),
        spark.createDataFrame([(i, "n", [1.0, 0.0]) for i in (1, 2, 3, 4)], "column_id int, data_type string, vector array<double>"),
        spark.createDataFrame(own, "query_table string, name string, data_type string, vector array<double>"),
    )
    assert [r.chart_columns for r in got.collect()] == [["c0", "c1", "c2", "c3"]] and kept == [4]


def test_cells_along_a_row(spark):
    numbers = spark.createDataFrame([(1, None, 2.0, None, 8.0, None), (2, None, None, None, None, None), (3, 4.0, None, None, 1.0, 0.0)], "n int, a double, b double, c double, d double, e double")
    assert [tuple(r)[1:] for r in C.interpolate_rows(numbers, list("abcde")).orderBy("n").collect()] == [(None, 2.0, 5.0, 8.0, 8.0), (None,) * 5, (4.0, 3.0, 2.0, 1.0, 0.0)]
    assert [tuple(r)[1:] for r in C.clean_interpolate(numbers, "n").orderBy("n").collect()] == [(4.0, 2.0, 5.0, 8.0, 8.0), (4.0, 2.5, 3.5, 4.5, 4.0), (4.0, 3.0, 2.0, 1.0, 0.0)]
    texts = spark.createDataFrame([(1, None, "x", None), (2, None, None, 7), (3, "y", None, None)], "n int, a string, b string, c int")
    assert [tuple(r)[1:] for r in C.clean_interpolate(texts, "n").orderBy("n").collect()] == [("y", "x", "x"), ("y", "y", "7"), ("y", "y", "y")]


def test_paths_meet_in_the_middle(spark):
    edges = spark.createDataFrame([("a1", "b1", "content", 0.9), ("a2", "b1", "content", 0.8), ("b2", "c1", "content", 0.5), ("c1", "d1", "content", 1.0), ("a1", "d1", "label", 1.0)], "column_id_1 string, column_id_2 string, kind string, certainty double")
    columns = spark.createDataFrame([(c, c[0]) for c in ("a1", "a2", "b1", "b2", "c1", "d1")], "column_id string, table_id string")
    got = {(r.t0, r.t1, r.t2, r.t3, tuple(tuple(s) for s in r.steps)): r.certainty for r in K.join_paths(edges, columns, "a", "d", 3).collect()}
    assert got == pytest.approx({("a", "b", "c", "d", ((x, "b1"), ("b2", "c1"), ("c1", "d1"))): y * 0.5 for x, y in (("a1", 0.9), ("a2", 0.8))})
    assert K.join_paths(edges, columns, "a", "b", 1).count() == 2 and K.join_paths(edges, columns, "a", "d", 1).count() == 0


def test_best_rows_hold_a_strip_of_products():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(1500, 4)), rng.integers(0, 3, size=(1500, 4)).astype(float)
    tracemalloc.start()
    order, score = best_rows(x, y, 3)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = np.round(x @ y.T, 12)
    assert (order == np.argsort(-whole, axis=1, kind="stable")[:, :3]).all() and (score == np.take_along_axis(whole, order, axis=1)).all()
    assert held < whole.nbytes / 2 and best_rows(x, y[:0], 3)[0].shape == (1500, 0)


def test_top_pairs_in_blocks(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"g{i % 2}", rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, "g0", [1.0, 1.0, 0.0, 0.0]) for i in range(5)] + [(200, "g0", [0.0] * 4), (201, "g0", None)]
    df = spark.createDataFrame(rows, "id long, group string, vector array<double>")
    got = {}
    for r in top_pairs(df.where("id % 10 = 0").withColumnRenamed("id", "query_id"), df, 4, block=9).orderBy("place").collect():
        got.setdefault(r.query_id, []).append(r.id)
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12)
    known = [r for r in rows if r[2] and any(r[2])]
    assert got == {q: [i for _, i in sorted((-cos(v, w), i) for i, h, w in known if h == g)[:4]] for q, g, v in known if q % 10 == 0}


def test_a_database_is_read_in_ranges(spark):
    url = "jdbc:derby:memory:lake"
    rows = spark.range(100).select(F.col("id").cast("int").alias("ID"), (F.col("id") * 2).cast("int").alias("TWICE"))
    rows.write.jdbc(url + ";create=true", "numbers", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    got = S.read_database(spark, url, "numbers", key="ID", partitions=4, where="ID < 50", options=options)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == [(i, 2 * i) for i in range(50)]
    assert S.read_database(spark, url, "numbers", columns=["TWICE"], options=options).count() == 100


def test_candidates_of_one_group_are_many_tasks(spark):
    cases = spark.createDataFrame([(i, "p" if i < 60 else None, i % 2) for i in range(64)], "case_id long, problem_type string, data_type int")
    met = V.candidate_cases(cases, block=4, keep=("data_type",))
    assert sorted((r.case_id, r.candidate_id) for r in met.collect()) == sorted((a, b) for a in range(60) for b in range(60) if a != b and a % 2 == b % 2)
    one = cases.select("case_id", F.lit("p").alias("problem_type"), F.lit("d").alias("data_type"))
    assert V.candidate_cases(one, block=4).select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert V.candidate_cases(cases.where("case_id = 1")).count() == 0 and V.candidate_cases(cases.limit(0)).count() == 0
    asked = V.candidate_cases(cases.where("case_id = 2"), cases, ("data_type",)).collect()
    assert sorted(r.candidate_id for r in asked) == [0, *range(4, 60, 2)] and {r.other_data_type for r in asked} == {0}


def test_modules_of_candidates_equal_modules_of_pairs(spark):
    """A score for each pair of rows, without a shuffle of pairs; weights of fields that one case lacks don't count."""
    pick = random.Random(3)
    values = {"n": ["1", "2.5", "x", "unknown", None], "s": ["A", "a", "b", "unknown"], "v": ['{"a": 1, "b": 2}', '{"b": 3}', "[1, 2]", "[0, 1]", "{", None], "m": ["MAR", "MCAR", "OTHER"], "d": ["uniform", "balanced", "normal"]}
    kinds = {"n": ("float", 0.7), "s": ("string", 0.3), "v": ("vector", 0.5), "m": ("missing_pattern", 0.2), "d": ("distribution", 0.4)}
    rows = [(i, "p", "d", "k", {f: pick.choice(v) for f, v in values.items() if pick.random() < 0.6}) for i in range(40)]
    cases = spark.createDataFrame(rows, "case_id long, problem_type string, data_type string, module string, fields map<string,string>")
    fields = spark.createDataFrame([(i, m, f, kinds[f][0], v) for i, _, _, m, held in rows for f, v in held.items()], "case_id long, module string, field string, kind string, value string")
    weights = spark.createDataFrame([(f, w) for f, (_, w) in kinds.items()], "field string, weight double")
    got = V.candidate_modules(cases, kinds)
    want = {(r.case_id, r.candidate_id): r.score for r in V.module_similarity(fields, V.candidate_cases(cases), weights).collect()}
    found = {(r.case_id, r.candidate_id): r.score for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == want[k] or abs(found[k] - want[k]) < 0.0011 for k in want)
    twice = V.candidate_modules(cases.where("case_id < 2").union(cases.where("case_id = 0")), {"s": ("string", 1.0)})
    assert twice.count() == 2 * 2 * ("s" in rows[0][4] and "s" in rows[1][4])


def test_even_rounds_as_bround(spark):
    from lakeloom.functions.columns import even

    xs = [*[i / 10_000 for i in range(-40, 41)], 0.0125, 1e9 + 0.0005, 123456.7885, float("nan"), None, 1 / 3, -0.00001]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(even(F.col("x"), 3).alias("a"), F.bround("x", 3).alias("b"))
    assert [repr(r.a) for r in df.collect()] == [repr(r.b) for r in df.collect()]


def test_impute_nearest_compares_different_rows_only(spark, monkeypatch):
    """Rows of a few values: fills equal those of all rows, and the donors that are dealt are k for each of the others' values."""
    pick = random.Random(8)
    rows = [(i, pick.choice([0.0, 1.0, 2.0, None]), pick.random() if i % 7 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    kept = []
    monkeypatch.setattr(C, "cut", lambda d: (kept.append(d.count()), d.localCheckpoint())[1], raising=False)
    got = {r.id: r.b for r in C.impute_nearest(df, ["a", "b"], "id", k=3).collect() if rows[r.id][2] is None}
    for i, a, _ in (r for r in rows if r[2] is None):
        near = sorted(((a - x) ** 2, j, y) for j, x, y in rows if a is not None and x is not None and y is not None)[:3]
        assert got[i] == (pytest.approx(sum(y for *_, y in near) / 3) if near else None)
    n_gaps, n_donors = kept
    assert n_gaps == 3 + sum(r[1] is None and r[2] is not None for r in rows)
    assert n_donors == 3 * 3 + sum(r[1] is not None and r[2] is not None for r in rows)


def test_interpolation_holds_one_run_in_a_task(spark):
    df = spark.createDataFrame([(i, float(i) if i % 9 == 0 else None) for i in range(400)], "n int, x double")
    out = C.interpolate(df, ["x"], "n", run=10).select("n", "x", F.spark_partition_id().alias("p")).collect()
    assert {r.n: r.x for r in out} == {i: pytest.approx(float(min(i, 396))) for i in range(400)}
    tasks = {}
    for r in out:
        tasks.setdefault(r.p, []).append(r.n)
    assert sorted(map(sorted, tasks.values())) == [[*range(i, i + 10)] for i in range(0, 400, 10)]


def test_column_matches_take_norms_from_columns(spark):
    """Cosines with norms found once a column are those without; scores equal plain ones."""
    rng = np.random.default_rng(5)
    rows = [(i // 4, i // 2, i, "int" if i % 2 else "float", rng.normal(size=3).tolist(), rng.normal(size=5).tolist()) for i in range(16)]
    rows.append((4, 8, 16, "int", [0.0] * 3, rng.normal(size=5).tolist()))
    columns = spark.createDataFrame(rows, "case_id long, table_id long, column_id long, data_type string, label array<double>, content array<double>")
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if a != b], "case_id long, candidate_id long")
    cos = lambda x, y: max(0.0, round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), 3)) if any(x) and any(y) else 0.0
    want = {}
    for a in rows:
        for b in (b for b in rows if b[0] != a[0]):
            key = (a[0], b[0], a[1], b[1], a[2])
            want[key] = max(want.get(key, 0.0), 0.4 * cos(a[4], b[4]) + 0.6 * cos(a[5], b[5]))
    got = {(r.case_id, r.candidate_id, r.table_id, r.other_table_id, r.column_id): r.score for r in V.column_matches(pairs, columns).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.00051 for k in want)
    from lakeloom.operators.pipelines import cosine, dot

    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    assert columns.where(~cosine(F.col("label"), F.col("label"), norm("label"), norm("label")).eqNullSafe(cosine(F.col("label"), F.col("label")))).count() == 0


def test_tables_of_every_case_are_matched(spark):
    """No case is left out as the one that asks: its tables meet those of all other cases of its label."""
    from lakeloom.plans import queries as Q

    path = "/root/testdata/sf0.001"
    heads = [(r.vec_id // 16, r.label) for r in spark.read.parquet(f"{path}/embeddings.parquet").where("vec_id % 16 = 0").collect()]
    met = {(r.case_id, r.candidate_id) for r in Q.QUERIES["v5_table_matches"](spark, path).select("case_id", "candidate_id").distinct().collect()}
    assert met == {(a, b) for a, p in heads for b, q in heads if a != b and p == q}
