"""Further registered queries: the lake's schema, types, pipelines' code, cases and checks of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.columns import name
from ..operators import assertions as A
from ..operators import catalog as K
from ..operators import correlation as M
from ..operators import features as X
from ..operators import models as G
from ..operators import outliers as O
from ..operators import pipelines as P
from ..operators import ranking as V
from ..sources import lake as S
from .queries import _CALLS, COLUMNS, COLUMNS_SQL, LABEL_EDGES, MEMBERS, _calls, _pipelines, query, rounded, schema, sizes

# ---- numbers

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _outlier_counts(columns, table):
    return " UNION ALL ".join(
        f"SELECT CASE WHEN n < 4 OR a = b THEN 0 ELSE (SELECT count(*) FROM {table} WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) END AS n_out, n FROM (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, count({c}) AS n FROM {table})" for c in columns
    )


@query(f"""WITH o AS ({_outlier_counts(("o_totalprice", "o_custkey"), "orders")} UNION ALL {_outlier_counts(("value",), "events")}), r AS (SELECT n_out / n AS r FROM o)
SELECT round_even(count(*) FILTER (WHERE r > 0 AND r < 0.05) / count(*), 4) AS mild_ratio, round_even(count(*) FILTER (WHERE r >= 0.05 AND r < 0.2) / count(*), 4) AS moderate_ratio, round_even(count(*) FILTER (WHERE r >= 0.2) / count(*), 4) AS severe_ratio, round_even(count(*) FILTER (WHERE r = 0) / count(*), 4) AS no_outliers_ratio FROM r""")
def o2_outlier_severity(t):
    wide = t.orders.select("o_totalprice", "o_custkey", F.lit(None).cast("double").alias("value")).union(t.events.select(F.lit(None).cast("double"), F.lit(None).cast("long"), "value"))
    return O.outlier_severity(wide)


_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


def _spearman_sql(a: str, b: str) -> str:
    both = f"SELECT {a} AS x, {b} AS y FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    return f"(SELECT corr(rx, ry) FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM ({both})))"


@query("SELECT round_even((" + " + ".join(f"(abs((SELECT corr({a}, {b}) FROM lineitem) - {_spearman_sql(a, b)}) > 0.2)::INT" for a, b in _PAIRS) + f") / {len(_PAIRS)}, 4) AS synergistic_interaction_ratio, round_even(6 / 10, 4) AS numerical_numerical, round_even(4 / 10, 4) AS categorical_numerical, 0.0::DOUBLE AS categorical_categorical")
def m11_synergy_unsupervised(t):
    return M.synergy_unsupervised(t.lineitem.select(*_NUMBERS, "l_returnflag"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round_even({_spearman_sql(a, b)}, 4) AS rho WHERE abs({_spearman_sql(a, b)}) >= 0.001" for a, b in _PAIRS))
def m8_redundant_pairs(t):
    return rounded(M.redundant_pairs(t.lineitem, 0.001, list(_NUMBERS)), 4, "rho")


def _r(a: str, b: str) -> str:
    return f"(SELECT corr({a}, {b}) FROM lineitem)"


# with one other column z: partial r = (rxy - rxz ryz) / sqrt((1 - rxz^2)(1 - ryz^2))
@query(f"""SELECT round_even(greatest(0, least(1, abs(xy) - abs((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))))), 4) AS confounder_strength FROM (SELECT {_r("l_extendedprice", "l_quantity")} AS xy, {_r("l_extendedprice", "l_tax")} AS xz, {_r("l_quantity", "l_tax")} AS yz)""")
def m13_confounder_strength(t):
    return G.confounder_strength(t.lineitem, "l_extendedprice", "l_quantity", ["l_tax"])


# ---- ids and types


@query("""SELECT o_orderkey, 'lake/' || o_orderpriority || '/' || o_orderkey AS raw_id, replace(replace('lake/' || o_orderpriority, ' ', '+'), '~', '~') AS case_id, CASE WHEN starts_with(o_orderpriority, '1-') THEN substr(o_orderpriority, 3) ELSE o_orderpriority END AS stripped, CAST(o_orderkey % 100 AS INT) AS statement FROM orders""")
def t5_ids(t):
    number = F.col("o_orderkey").cast("string")
    return t.orders.select("o_orderkey", F.concat_ws("/", F.lit("lake"), "o_orderpriority", number).alias("raw_id"), L.path_id(F.lit("lake"), F.col("o_orderpriority")).alias("case_id"), L.strip_prefix(F.col("o_orderpriority"), "1-").alias("stripped"), L.statement_no(F.concat(F.lit("lake/file/s"), (F.col("o_orderkey") % 100).cast("string"))).alias("statement"))


@query(f"""WITH {_CALLS} SELECT DISTINCT lib || '.' || module AS component, lib AS library, module FROM calls""")
def t12_library_and_module(t):
    return _calls(t).select("component", L.library_of(F.col("component")).alias("library"), L.module_of(F.col("component")).alias("module")).distinct()


def _type_sql(table: str, column: str) -> str:
    x = f'"{column}"'
    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, CASE WHEN count({x}) = 0 THEN 'string' WHEN count(*) FILTER (WHERE regexp_full_match(trim({x}), '[+-]?\\d+')) = count({x}) THEN CASE WHEN min(try_cast({x} AS BIGINT)) = 0 AND max(try_cast({x} AS BIGINT)) = 1 THEN 'boolean' ELSE 'int' END
WHEN count(try_cast({x} AS DOUBLE)) = count({x}) THEN 'float' WHEN count(*) FILTER (WHERE lower({x}) IN ('true', 'false')) = count({x}) THEN 'boolean' WHEN count(*) FILTER (WHERE try_cast({x} AS DATE) IS NOT NULL AND length({x}) < 50) > 0.5 * count({x}) THEN 'date'
WHEN count(*) FILTER (WHERE len(regexp_extract_all(substr({x}, 1, 100), '\\S+')) >= 2 AND len(list_filter(regexp_split_to_array(substr({x}, 1, 100), '\\s+'), lambda w: regexp_full_match(w, '\\p{{L}}+[.,;:!?]?'))) > 0.5 * len(regexp_extract_all(substr({x}, 1, 100), '\\S+'))) > 0.5 * count({x}) THEN 'natural_language_text' ELSE 'string' END AS data_type
FROM (SELECT CAST({x} AS VARCHAR) AS {x} FROM {table})"""


@query(" UNION ALL ".join(_type_sql(t, c) for t, cs in (("orders", COLUMNS["orders"]), ("part", COLUMNS["part"]), ("documents", ("text", "lang", "n_chars")), ("labels", ("toxic",))) for c in cs))
def t1_detect_types(t):
    """Types found from the cells alone: every column is read as text, as from a CSV file."""
    from functools import reduce

    from pyspark.sql import DataFrame

    chosen = {"orders": list(COLUMNS["orders"]), "part": list(COLUMNS["part"]), "documents": ["text", "lang", "n_chars"], "labels": ["toxic"]}
    texts = [getattr(t, n).select(*[name(c).cast("string").alias(c) for c in cs]) for n, cs in chosen.items()]
    return reduce(DataFrame.union, [K.detect_types(df).select(F.lit(n).alias("table_name"), "column_name", "data_type") for n, df in zip(chosen, texts, strict=True)])


@query(f"""WITH {COLUMNS_SQL}, c AS (SELECT table_name, regexp_replace(column_name, '^[a-z]+_', '') AS column_name FROM cols), a AS (SELECT DISTINCT column_name, true AS old FROM c WHERE table_name = 'orders'), b AS (SELECT DISTINCT column_name, true AS new FROM c WHERE table_name = 'lineitem')
SELECT column_name, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b USING (column_name)""")
def t19_schema_diff(t):
    return K.schema_diff(_bare(t), "orders", "lineitem")


def _bare(t):
    """The lake's columns without their tables' prefixes."""
    return schema(t).withColumn("column_name", F.regexp_replace("column_name", "^[a-z]+_", ""))


# ---- the lake


@query(f"WITH {COLUMNS_SQL} SELECT 'tpch' AS dataset_name, count(DISTINCT table_id) AS n_tables FROM cols")
def q1_datasets_info(t):
    return K.datasets_info(schema(t))


@query("SELECT 'tpch' AS dataset_name, 'orders' AS table_name, (SELECT count(*) FROM orders) AS n_rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = 'orders') AS n_columns")
def q3_table_info(t):
    return K.tables_info(sizes(t), "tpch").where("table_name = 'orders'")


@query(f"""WITH {LABEL_EDGES}, s AS (SELECT t1 AS src, t2 AS dst, certainty AS c FROM label_edges UNION ALL SELECT t2, t1, certainty FROM label_edges)
SELECT a.src AS t0, a.dst AS t1, b.dst AS t2, round_even(max(a.c * b.c), 4) AS certainty FROM s a JOIN s b ON a.dst = b.src WHERE a.src = 'lake/tpch/orders' AND b.dst = 'lake/tpch/supplier' GROUP BY 1, 2, 3""")
def q8_join_paths(t):
    columns = schema(t)
    paths = K.join_paths(K.label_similarity(columns, 0.75, "^[a-z]+_"), columns, "lake/tpch/orders", "lake/tpch/supplier", 2, "label")
    return rounded(paths.groupBy("t0", "t1", "t2").agg(F.max("certainty").alias("certainty")), 4, "certainty")


@query(f"WITH {COLUMNS_SQL} SELECT DISTINCT table_id FROM cols WHERE table_name = 'orders'")
def q9_table_ids(t):
    return K.table_ids(schema(t), "tpch", "orders")


@query("SELECT vec_id AS column_id, vec_id IN (SELECT doc_id FROM labels) AS has_ops FROM embeddings")
def q11_flag_operations(t):
    return K.flag_operations(t.embeddings.select(F.col("vec_id").alias("column_id")), t.labels.select(F.col("doc_id").alias("column_id")))


@query("""WITH s AS (SELECT l_orderkey AS query_id, l_partkey AS column_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS place FROM lineitem), o AS (SELECT p_partkey AS column_id, p_brand AS analysis_type, p_size AS chart_type FROM part)
SELECT query_id, analysis_type, chart_type, column_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, analysis_type, chart_type ORDER BY place, column_id) AS n FROM s JOIN o USING (column_id)) WHERE n = 1""")
def q12_recommend_charts(t):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    similar = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("column_id"), place.alias("place"))
    return K.recommend_charts(similar, t.part.select(F.col("p_partkey").alias("column_id"), F.col("p_brand").alias("analysis_type"), F.col("p_size").alias("chart_type")))


@query("SELECT title AS value FROM (SELECT o_orderkey AS case_id, o_orderpriority AS title FROM orders) WHERE case_id = (SELECT min(o_orderkey) FROM orders)")
def q14_case_field(t):
    cases = t.orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("title"))
    return K.case_field(cases, cases.agg(F.min("case_id")).first()[0], "title")


@query(f"WITH RECURSIVE {MEMBERS}, below AS (SELECT s AS node FROM members WHERE o = 'lake' UNION SELECT m.s FROM members m JOIN below ON m.o = below.node) SELECT DISTINCT node FROM below")
def s15_descendants(t):
    return K.descendants(K.membership_triples(schema(t)), "lake")


@query("""SELECT doc_id || '/m' AS s, 'hasToxic Share' AS p, lower(CAST(toxic = 1 AS VARCHAR)) AS o, 'text' AS o_type FROM labels UNION ALL SELECT doc_id || '/m', 'hasLabel', CAST(toxic AS VARCHAR), 'number' FROM labels""")
def l2_insight_triples(t):
    one = lambda field, kind, value: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), value.alias("value"))
    rows = F.array(one("toxic_share", "boolean", (F.col("toxic") == 1).cast("string")), one("label", "int", F.col("toxic").cast("string")))
    return K.insight_triples(t.labels.select(F.col("doc_id").cast("string").alias("case_id"), F.lit("m").alias("module"), F.explode(rows).alias("r")).select("case_id", "module", "r.*"))


_SHARES = "shares AS (SELECT 'b' || p_size AS column_id, p_brand AS table_id, avg((p_retailprice > 1200)::INT) AS r FROM part GROUP BY p_size, p_brand)"


@query(f"WITH {_SHARES} SELECT * FROM (SELECT a.column_id || '/' || a.table_id AS column_id_1, b.column_id || '/' || b.table_id AS column_id_2, 'content' AS kind, round_even(1 - abs(a.r - b.r), 4) AS certainty FROM shares a JOIN shares b ON a.column_id = b.column_id AND a.table_id < b.table_id) WHERE certainty >= 0.75")
def l4_boolean_similarity(t):
    """Shares of dear parts by size and brand as boolean columns; of one size, so that the pairs stay few."""
    shares = t.part.groupBy(F.concat(F.lit("b"), F.col("p_size")).alias("size"), F.col("p_brand").alias("table_id")).agg(F.avg((F.col("p_retailprice") > 1200).cast("int")).alias("true_ratio"))
    columns = shares.select(F.concat_ws("/", "size", "table_id").alias("column_id"), "table_id", F.lit("boolean").alias("data_type"), "true_ratio")
    edges = K.boolean_similarity(columns)
    same = F.split_part("column_id_1", F.lit("/"), F.lit(1)) == F.split_part("column_id_2", F.lit("/"), F.lit(1))
    return rounded(edges.where(same), 4, "certainty")


# ---- pipelines


@query(f"""WITH {_CALLS}, d AS (SELECT o_orderkey AS pipeline_id FROM orders WHERE o_orderpriority = '5-LOW') SELECT DISTINCT pipeline_id, lib || '.' || module AS component FROM calls JOIN d USING (pipeline_id) WHERE lib IN ('Brand#11', 'Brand#22', 'Brand#1', 'Brand#2')""")
def p4_search_components(t):
    calls = _calls(t)
    classes = calls.select("component").where(L.library_of(F.col("component")).isin("Brand#11", "Brand#22", "Brand#1", "Brand#2")).distinct()
    return P.search_components(calls, _pipelines(t), "5-LOW", classes)


_FIRST_CALL = "(SELECT min(lib || '.' || module) FROM calls)"


@query(f"""WITH {_CALLS} SELECT DISTINCT pipeline_id, 'quantity' AS parameter, CAST(l_quantity AS BIGINT)::VARCHAR AS value FROM calls JOIN lineitem ON pipeline_id = l_orderkey JOIN part ON l_partkey = p_partkey AND lib = p_brand AND module = replace(p_type, ' ', '_') WHERE lib || '.' || module = {_FIRST_CALL}""")
def p5_hyperparameters(t):
    calls = _calls(t)
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    component = F.concat_ws(".", "p_brand", F.replace("p_type", F.lit(" "), F.lit("_")))
    params = lines.select(F.col("l_orderkey").alias("pipeline_id"), component.alias("component"), F.lit("quantity").alias("parameter"), F.col("l_quantity").cast("long").cast("string").alias("value"))
    return P.hyperparameters(calls, params, calls.agg(F.min("component")).first()[0])


@query(f"""WITH {_CALLS}, h AS (SELECT DISTINCT 'lib_' || lib AS library, 'plot_' || module AS module, pipeline_id FROM calls), top AS (SELECT library FROM h GROUP BY 1 ORDER BY count(DISTINCT pipeline_id) DESC, library LIMIT 3) SELECT * FROM h WHERE library IN (SELECT library FROM top)""")
def p7_task_libraries(t):
    calls = _calls(t).select("pipeline_id", F.concat(F.lit("lib_"), F.regexp_replace("component", r"\.", ".plot_")).alias("component"))
    return P.task_libraries(calls, "visualization", 3)


@query("""SELECT o_orderkey AS pipeline_id, o_totalprice AS score FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def p9_tagged_pipelines(t):
    tags = t.lineitem.select(F.col("l_orderkey").alias("pipeline_id"), F.when(F.col("l_returnflag") == "R", "Deep Learning").otherwise("other").alias("tag"))
    return P.tagged_pipelines(_pipelines(t), tags).select("pipeline_id", "score")


@query(f"""WITH {_CALLS} SELECT DISTINCT lib || '.' || module AS transformation, pipeline_id, l_linestatus AS table_name, o_orderpriority AS dataset_id FROM calls JOIN lineitem ON l_orderkey = pipeline_id JOIN orders ON o_orderkey = pipeline_id WHERE contains(lower(module), 'steel')""")
def p10_transformations(t):
    reads = t.lineitem.select(F.col("l_orderkey").alias("pipeline_id"), F.col("l_linestatus").alias("table_name"))
    return P.transformations(_calls(t), reads, _pipelines(t), "steel")


@query("SELECT count(DISTINCT o_orderkey) AS n_pipelines FROM orders")
def p13_pipeline_count(t):
    return P.pipeline_count(_pipelines(t))


@query("""SELECT l_linenumber AS n, l_shipdate::VARCHAR || ' ' || l_partkey AS text FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_returnflag = 'R') AND l_returnflag = 'R'""")
def p15_insight_code(t):
    lines = t.lineitem.withColumn("number", F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"))
    statements = lines.select(F.col("l_orderkey").alias("pipeline_id"), F.col("number").alias("n"), F.concat_ws(" ", F.col("l_shipdate").cast("string"), F.col("l_partkey").cast("string")).alias("text"))
    spans = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("insight_id"), F.col("l_orderkey").alias("pipeline_id"), F.col("number").alias("n"))
    return P.insight_code(spans, statements, spans.agg(F.min("insight_id")).first()[0]).select(F.col("n.l_linenumber").alias("n"), "text")


@query("""SELECT conv_id AS pipeline_id, role AS phase, CAST(turn AS VARCHAR) AS insight_id FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL UNION ALL SELECT conv_id, 'cross', CAST(max(turn) AS VARCHAR) FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id""")
def p18_flatten_insights(t):
    turns = t.conversations.where("conv_id IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL").groupBy(F.col("conv_id").alias("pipeline_id"), "role").agg(F.collect_list(F.col("turn").cast("string")).alias("ids"), F.max("turn").alias("last"))
    whole = turns.groupBy("pipeline_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "ids"))).alias("by_phase"), F.array(F.max("last").cast("string"), F.lit("")).alias("across"))
    return P.flatten_insights(whole, "by_phase", "across")


# ---- ranking

_L2 = "round_even(1 - sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))), 3)"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, c.vec_id, {_L2} AS score FROM q JOIN v c ON q.label = c.label AND q.vec_id <> c.vec_id)
SELECT query_id, max(score) AS best FROM s GROUP BY 1""")
def v1_vector_scores(t):
    """The best score of each query among the rows of its label: 1 - Euclidean distance, the query's own row excluded."""
    vectors = F.transform("embedding", lambda x: x.cast("double"))
    rows = t.embeddings.select(F.col("vec_id").alias("case_id"), F.col("label").alias("problem_type"), F.lit("vector").alias("data_type"), vectors.alias("v"))
    met = V.candidate_cases(rows.where("case_id % 20 = 0"), rows, ("v",), block=64)
    return met.groupBy(F.col("case_id").alias("query_id")).agg(F.max(P.l2_score(F.col("v"), F.col("other_v"))).alias("best"))


@query("""WITH f AS (SELECT c_custkey AS case_id, c_acctbal AS x, c_mktsegment AS s FROM customer) SELECT a.case_id, b.case_id AS candidate_id, round_even(CASE WHEN greatest(abs(a.x), abs(b.x)) = 0 THEN 1 ELSE greatest(0, 1 - abs(a.x - b.x) / greatest(abs(a.x), abs(b.x))) END, 4) AS number, CASE WHEN lower(a.s) = lower(b.s) THEN 1.0 ELSE 0.0 END::DOUBLE AS text FROM f a JOIN f b ON b.case_id = a.case_id + 1""")
def v7_field_similarity(t):
    """Similarity of the fields of each customer and the next one."""
    a = t.customer.select(F.col("c_custkey").alias("case_id"), F.col("c_acctbal").cast("string").alias("x"), F.col("c_mktsegment").alias("s"))
    b = t.customer.select((F.col("c_custkey") - 1).alias("case_id"), F.col("c_custkey").alias("candidate_id"), F.col("c_acctbal").cast("string").alias("y"), F.col("c_mktsegment").alias("r"))
    number, text = V.field_similarity(F.lit("float"), F.col("x"), F.col("y")), V.field_similarity(F.lit("string"), F.col("s"), F.col("r"))
    return a.join(b, "case_id").select("case_id", "candidate_id", F.bround(number, 4).alias("number"), text.alias("text"))


@query("""WITH p AS (SELECT o_custkey AS case_id, o_orderstatus AS module, round_even(avg(o_totalprice) / 1000000, 4) AS score FROM orders GROUP BY 1, 2), c AS (SELECT DISTINCT case_id FROM p)
SELECT case_id, case_id AS candidate_id, coalesce(max(score) FILTER (WHERE module = 'F'), 0) AS "F", coalesce(max(score) FILTER (WHERE module = 'O'), 0) AS "O", round_even((coalesce(max(score) FILTER (WHERE module = 'F'), 0) * 2.0 + coalesce(max(score) FILTER (WHERE module = 'O'), 0) * 1.0) / 3.0, 3) AS total FROM c JOIN p USING (case_id) GROUP BY 1""")
def v9_insight_similarity(t):
    modules = t.orders.groupBy(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("module")).agg(F.bround(F.avg("o_totalprice") / 1000000, 4).alias("score")).withColumn("candidate_id", F.col("case_id"))
    pairs = modules.select("case_id", "candidate_id").distinct()
    return V.insight_similarity(modules, pairs, {"F": 2.0, "O": 1.0})


@query("""WITH b AS (SELECT o_orderpriority AS dataset_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey AS pipeline_id FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IN ('1-URGENT', '5-LOW')), i AS (SELECT l_orderkey AS pipeline_id, list_sort(list(DISTINCT l_partkey)) AS insights FROM lineitem GROUP BY 1)
SELECT dataset_id, place::INT AS place, pipeline_id, insights FROM b LEFT JOIN i USING (pipeline_id) WHERE place <= 3""")
def v12_insights_for_cases(t):
    cases = t.orders.where("o_orderpriority IN ('1-URGENT', '5-LOW')").select(F.col("o_orderpriority").alias("dataset_id"))
    return P.insights_for_cases(cases, _pipelines(t), t.lineitem.select(F.col("l_orderkey").alias("pipeline_id"), F.col("l_partkey").alias("insight_id")), 3)


@query("SELECT conv_id, turn FROM conversations WHERE lower(trim(role)) = 'user'")
def v13_phase_filter(t):
    return V.phase_filter(t.conversations.select("conv_id", "turn", F.col("role").alias("phase")), " User ").select("conv_id", "turn")


@query("""SELECT o_custkey AS case_id, o_orderpriority AS module, round_even(100 * count(*) FILTER (WHERE o_orderstatus <> 'O') / count(*), 1) AS completeness FROM orders GROUP BY 1, 2""")
def t15_completeness(t):
    fields = t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("module"), F.when(F.col("o_orderstatus") == "O", "unknown").otherwise(F.col("o_orderstatus")).alias("value"))
    return V.insight_completeness(fields)


@query("""SELECT l_orderkey AS id, l_linenumber AS step, l_shipmode AS "case", l_partkey::VARCHAR AS pipeline, l_suppkey::VARCHAR AS insight FROM (SELECT l_orderkey, 1 AS l_linenumber, l_returnflag AS l_shipmode, l_partkey, l_suppkey FROM lineitem)""")
def v16_plan_references(t):
    reference = F.format_string("Plan\nSTEP one: Competition[%s] -> Pipeline[%s] ->  Insight[%s] and so on", "l_returnflag", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return V.plan_references(t.lineitem.select(F.col("l_orderkey").alias("id"), reference.alias("plan")), "id", "plan")


# ---- checks of columns


@query(f"""WITH {COLUMNS_SQL}, r AS (SELECT * FROM (VALUES ('tpch', 'orders'), ('tpch', 'refunds'), ('other', 'part')) AS v("case", table_name)), m AS (SELECT "case", string_agg(table_name, ',' ORDER BY table_name) AS names FROM r WHERE NOT EXISTS (SELECT 1 FROM cols WHERE cols.table_name = r.table_name AND r."case" = 'tpch') GROUP BY 1)
SELECT 'required_tables' AS "check", r."case" AS subject, bool_and(names IS NULL) AS passed, coalesce(max(names), '') AS detail FROM r LEFT JOIN m USING ("case") GROUP BY r."case" """)
def a1_required_tables(t):
    required = t.spark.createDataFrame([("tpch", "orders"), ("tpch", "refunds"), ("other", "part")], "case string, table_name string")
    return A.required_tables(required, schema(t).select(F.col("dataset_name").alias("case"), "table_name").distinct())


_BARE = f"{COLUMNS_SQL}, bare AS (SELECT table_name, regexp_replace(column_name, '^[a-z]+_', '') AS column_name, position FROM cols)"
_LACKING = "SELECT column_name FROM bare WHERE table_name = 'orders' AND column_name NOT IN (SELECT column_name FROM bare WHERE table_name = 'lineitem')"


@query(f"WITH {_BARE} {_LACKING}")
def a7_target_columns(t):
    return A.target_columns(_bare(t), "orders", "lineitem")


@query(f"""WITH {_BARE}, s AS (SELECT count(*) FILTER (WHERE table_name = 'supplier') - count(*) FILTER (WHERE table_name = 'nation') AS more FROM bare) SELECT 'target_count' AS "check", 'supplier,nation' AS subject, more = 1 AND (SELECT count(*) FROM bare WHERE table_name = 'supplier' AND column_name NOT IN (SELECT column_name FROM bare WHERE table_name = 'nation')) >= 1 AS passed, more::VARCHAR AS detail FROM s""")
def a8_target_count(t):
    return A.target_count(_bare(t), "supplier", "nation", 1)


@query(f"""WITH {_BARE}, n AS (SELECT table_name, list(column_name ORDER BY position) AS names FROM bare GROUP BY 1) SELECT 'same_columns' AS "check", 'customer,supplier' AS subject, (SELECT names FROM n WHERE table_name = 'customer') = (SELECT names FROM n WHERE table_name = 'supplier') AS passed, ((SELECT len(names) FROM n WHERE table_name = 'customer') - (SELECT len(names) FROM n WHERE table_name = 'supplier'))::VARCHAR AS detail""")
def a11_same_columns(t):
    return A.same_columns(_bare(t), "customer", "supplier")


@query(f"""WITH {_BARE}, a AS (SELECT column_name AS x FROM bare WHERE table_name = 'customer' AND column_name NOT IN (SELECT column_name FROM bare WHERE table_name = 'supplier')), b AS (SELECT column_name AS y FROM bare WHERE table_name = 'customer' AND lower(column_name) NOT IN ('name', 'acctbal', 'nationkey')), j AS (SELECT x, y FROM a FULL JOIN b ON x = y)
SELECT 'targets_consistent' AS "check", 'customer,customer' AS subject, count(*) FILTER (WHERE x IS NULL OR y IS NULL) = 0 AND count(x) > 0 AND count(y) > 0 AS passed, (count(*) FILTER (WHERE x IS NULL OR y IS NULL))::VARCHAR AS detail FROM j""")
def a17_targets_consistent(t):
    return A.targets_consistent(_bare(t), "customer", "supplier", "customer", ("name", "acctbal", "nationkey"))


@query(f"""WITH {_BARE}, x AS (SELECT column_name FROM bare WHERE table_name = 'supplier' AND column_name NOT IN (SELECT column_name FROM bare WHERE table_name = 'customer') UNION ALL SELECT column_name FROM bare WHERE table_name = 'customer' AND column_name NOT IN (SELECT column_name FROM bare WHERE table_name = 'supplier') AND column_name <> 'mktsegment')
SELECT 'features_consistent' AS "check", 'customer,supplier' AS subject, count(*) = 0 AS passed, count(*)::VARCHAR AS detail FROM x""")
def a18_features_consistent(t):
    return A.features_consistent(_bare(t), "customer", "supplier", t.spark.createDataFrame([("mktsegment",)], "column_name string"))


@query("""WITH l AS (SELECT l_orderkey AS file, l_linenumber - 1 AS n, CASE WHEN l_linenumber <= l_orderkey % 5 THEN [l_returnflag, l_linestatus] ELSE [l_returnflag, CAST(l_quantity AS VARCHAR)] END AS cells FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)),
h AS (SELECT file, n, len(list_filter(cells, lambda c: try_cast(c AS DOUBLE) IS NULL)) / len(cells) >= 0.8 AS header FROM l WHERE n < 5), r AS (SELECT file, count(*) AS lines, coalesce(min(n) FILTER (WHERE NOT header), max(n) + 1) AS headers FROM h GROUP BY 1)
SELECT 'single_header' AS "check", file AS subject, lines < 2 OR headers NOT BETWEEN 2 AND 3 AS passed, headers::VARCHAR AS detail FROM r""")
def a19_single_header(t):
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_quantity").alias("q"))
    second = F.when(F.col("l_linenumber") <= F.col("l_orderkey") % 5, F.col("s")).otherwise(F.col("q").cast("string"))
    return A.single_header(rows.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") - 1).alias("n"), F.concat_ws(",", "f", second).alias("text")))


@query(f"""WITH {COLUMNS_SQL} SELECT 'rows_preserved' AS "check", 'orders' AS subject, (SELECT count(*) FROM orders) = (SELECT count(DISTINCT o_orderkey) FROM orders) AS passed, ((SELECT count(DISTINCT o_orderkey) FROM orders) - (SELECT count(*) FROM orders))::VARCHAR AS detail UNION ALL SELECT 'has_id_column', table_name, count(*) FILTER (WHERE column_name = 'event_id') > 0, (count(*) FILTER (WHERE column_name = 'event_id'))::VARCHAR FROM cols GROUP BY table_name""")
def a20_run_checks(t):
    return A.run_checks(A.rows_preserved(t.orders, t.orders.select("o_orderkey").distinct(), "orders"), A.has_id_column(schema(t), ["event_id"]))


# ---- vectors and sources


@query("""WITH e AS (SELECT label AS table_id, CASE WHEN vec_id % 2 = 0 THEN 'int' ELSE 'float' END AS data_type, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), m AS (SELECT table_id, data_type, avg(v[1]) AS a, avg(v[2]) AS b FROM e GROUP BY 1, 2)
SELECT table_id, list_transform([coalesce(max(a) FILTER (WHERE data_type = 'int'), 0), coalesce(max(b) FILTER (WHERE data_type = 'int'), 0), coalesce(max(a) FILTER (WHERE data_type = 'float'), 0), coalesce(max(b) FILTER (WHERE data_type = 'float'), 0)], lambda x: round_even(x, 4)) AS vector FROM m GROUP BY 1""")
def f8_table_vectors(t):
    profiles = t.embeddings.where("embedding IS NOT NULL").select(F.col("label").alias("table_id"), F.when(F.col("vec_id") % 2 == 0, "int").otherwise("float").alias("data_type"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("embedding"))
    return X.table_vectors(profiles, ["int", "float"], 2).select("table_id", F.transform("vector", lambda x: F.bround(x, 4)).alias("vector"))


@query("""SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN [embedding[1]::DOUBLE, embedding[2]::DOUBLE, 0, 0] ELSE [0, 0, embedding[1]::DOUBLE, embedding[2]::DOUBLE] END AS vector FROM embeddings WHERE embedding IS NOT NULL""")
def f9_padded_vectors(t):
    kind = F.when(F.col("vec_id") % 2 == 0, "int").otherwise("float")
    first = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    return t.embeddings.where("embedding IS NOT NULL").select("vec_id", X.padded_vector(kind, first, ["int", "float"], 2).alias("vector"))


@query("""WITH l AS (SELECT o_custkey AS path, o_orderkey AS n, 'lake/' || o_custkey || '/file' AS graph FROM orders) SELECT path, arg_min(graph, n) AS graph FROM l GROUP BY 1""")
def s8_graph_of_file(t):
    line = F.concat(F.lit("<lake/"), F.col("o_custkey").cast("string"), F.lit("/file/s"), F.col("o_orderkey").cast("string"), F.lit("> <p> <o> ."))
    return S.graph_of_file(t.orders.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("n"), line.alias("line")))


@query("SELECT vec_id AS id, label FROM embeddings")
def s9_upsert_vectors(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return S.upsert_vectors(rows.union(rows.where("id % 2 = 0")), rows.where("id % 3 = 0"))


# ---- profiles of one case, and the user's own queries


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS place FROM orders) WHERE CASE WHEN n > 10000 THEN ('0x' || substr(h, 1, 7))::BIGINT % 10 = 0 ELSE place <= 1000 END""")
def k6_profile_sample(t):
    return K.profile_sample(t.orders.select("o_orderkey"), "o_orderkey")


@query("""WITH w AS (SELECT conv_id, turn, unnest([conv_id, turn]) AS word FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), m AS (SELECT conv_id, turn, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM w JOIN embeddings ON vec_id = word WHERE embedding IS NOT NULL), a AS (SELECT conv_id, turn, i, avg(x) AS x FROM m GROUP BY 1, 2, 3)
SELECT conv_id, turn, list(round_even(x, 4) + 0.0 ORDER BY i) AS vector, round_even(max(abs(x)), 4) AS scale FROM a GROUP BY 1, 2""")
def k8_text_vectors(t):
    """Turns as texts of two numbers, and embeddings as the vectors of such words."""
    texts = t.conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    texts = texts.select(F.struct("conv_id", "turn").alias("id"), F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("text"))
    words = t.embeddings.where("embedding IS NOT NULL").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vector"))
    return K.text_vectors(texts, words).select("id.*", F.transform("vector", lambda x: F.bround(x, 4)).alias("vector"), F.bround("scale", 4).alias("scale"))


@query(f"WITH {COLUMNS_SQL} SELECT table_name, column_name, CASE WHEN table_name = 'orders' THEN 'new' ELSE 'old' END AS state FROM cols")
def k9_replace_profiles(t):
    stored = schema(t).withColumn("state", F.lit("old"))
    return K.replace_profiles(stored, stored.where("table_name = 'orders'").withColumn("state", F.lit("new"))).select("table_name", "column_name", "state")


@query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def q13_ask(t):
    return K.ask({"orders": t.orders, "customer": t.customer}, "SELECT o_orderpriority, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")


@query(f"""WITH {_CALLS}, said AS (SELECT 'pipeline/' || o_orderkey AS s, 'hasScore' AS p, round_even(o_totalprice, 3)::DOUBLE::VARCHAR AS o FROM orders WHERE o_totalprice <> 0 UNION SELECT 'pipeline/' || o_orderkey, 'isPartOf', '<' || o_orderpriority || '>' FROM orders UNION SELECT 'pipeline/' || pipeline_id, 'callsLibrary', '<' || lib || '>' FROM calls),
lists AS (SELECT s, p, string_agg(o, ', ' ORDER BY o) AS os FROM said WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY 1, 2) SELECT '<' || s || '> ' || string_agg('<' || p || '> ' || os, ' ;' || chr(10) || chr(9) ORDER BY p) || ' .' AS block FROM lists GROUP BY s""")
def s7_pipeline_blocks(t):
    return S.turtle_blocks(S.pipeline_triples(_pipelines(t), _calls(t)))


@query("SELECT 'dear' AS column_name, count(*) AS total_values_count, count(DISTINCT p_retailprice > 1200) AS distinct_values_count, round_even(count(*) FILTER (WHERE p_retailprice > 1200) / count(*), 4) AS true_ratio FROM part")
def k4_true_ratio(t):
    dear = t.part.select((F.col("p_retailprice") > 1200).alias("dear"))
    return rounded(K.profile_table(dear, "lake", "tpch", "part").select("column_name", "total_values_count", "distinct_values_count", "true_ratio"), 4, "true_ratio")
