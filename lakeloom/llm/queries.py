"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out
from .decontaminate import find_leaks
from .fingerprints import edited_likeness
from .jaccard_join import jaccard_join
from .language_id import identify_languages, learn_languages
from .licenses import LICENSE_SQL, scan_licenses
from .mixing import mix_sources
from .periodic_runs import find_runs
from .prefix_trie import conversation_trie
from .token_counts import token_counts
from .token_ids import token_id_table
from .topk import TOP_K_SQL, top_k_products
from .toxicity import learn_toxicity, score_toxicity
from .url_filter import filter_urls

#: (verdict, host, path) of the URL filter.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, learn_languages(docs.where(~held_out())), {"doc_id": F.col("doc_id"), "held_out": held_out()})


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_products(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn_toxicity(docs, labels.where(~held_out()))
    return score_toxicity(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out()})


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("times")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_table(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, by h = crc32(doc_id as text), with each word i >= a replaced by word a + (i - a) % p;
    a and p follow from floor(h / 10). The others, and those of rows without an id, stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), chosen.alias("words")).withColumn("n", F.greatest(F.size("words"), F.lit(0)))
    at = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    plan = at.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    word = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return plan.select("doc_id", F.when(F.col("n") > 0, F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_periods(table(spark, sf_dir, "documents")), {"doc_id": F.col("doc_id")})
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


URL_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM p
), rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN m ON s.page_id = m.page_id AND m.n = 1
"""


def _crc_nibbles() -> str:
    """The 16 remainders of CRC-32 by half bytes, from its polynomial, as a SQL list."""
    out = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ 0xEDB88320 * (i & 1)
        out.append(f"{i}::BIGINT")
    return f"[{', '.join(out)}]"


#: Digits' CRC-32 by half bytes; prefixes as lists of turns; every node adds its values to its smallest member's prefixes.
TRIE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text)) - 1 AS idx
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), k AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1
), crc AS (
  SELECT conv_id, conv_id::VARCHAR AS s, 1 AS i, 4294967295::BIGINT AS c FROM k
  UNION ALL
  SELECT conv_id, s, i + 1, xor({_crc_nibbles()}[((xor(c1, b >> 4)) & 15) + 1], c1 >> 4)
  FROM (SELECT conv_id, s, i, b, xor({_crc_nibbles()}[((xor(c, b)) & 15) + 1], c >> 4) AS c1 FROM (SELECT *, ascii(s[i])::BIGINT AS b FROM crc WHERE i <= length(s)))
), plan AS (
  SELECT k.conv_id, h, least(h, coalesce(b.n, 0)) AS taken, least(h, coalesce(b.n, 0)) + greatest(k.n - h, 0) AS size
  FROM k JOIN (SELECT conv_id, xor(max_by(c, i), 4294967295) % 9 AS h FROM crc GROUP BY 1) USING (conv_id) LEFT JOIN k AS b ON b.conv_id = k.conv_id - k.conv_id % 5
), r AS (
  SELECT p.conv_id, t.idx - h + taken AS pos, role, text, size FROM t JOIN plan AS p USING (conv_id) WHERE t.idx >= h
  UNION ALL
  SELECT p.conv_id, t.idx, role, text, size FROM plan AS p JOIN t ON t.conv_id = p.conv_id - p.conv_id % 5 WHERE t.idx < taken
), pre AS (
  SELECT conv_id, pos + 1 AS depth, list({{'r': role, 'x': text}}) OVER (PARTITION BY conv_id ORDER BY pos) AS p, strlen(text) AS n_bytes, size FROM r
  UNION ALL
  SELECT conv_id, 0, [], 0, size FROM plan
), node AS (
  SELECT p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256 FROM pre GROUP BY p
), up AS (
  SELECT node.p, pre.p AS parent FROM node JOIN pre ON pre.conv_id = node.conv_id AND pre.depth = node.depth - 1
), kids AS (SELECT parent AS p, count(*) AS n_children FROM up GROUP BY 1
), own AS (SELECT node.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * n_bytes AS saved FROM node LEFT JOIN kids USING (p)
), tot AS (
  SELECT pre.p, sum((own.n_children = 0)::INT)::BIGINT AS n_leaves, sum(own.saved)::BIGINT AS saved_tokens FROM own JOIN pre ON pre.conv_id = own.conv_id AND pre.depth <= own.depth GROUP BY 1
)
SELECT own.conv_id, own.depth::BIGINT AS depth, top.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, own.ends_sha256
FROM own JOIN tot USING (p) LEFT JOIN up USING (p) LEFT JOIN node AS top ON top.p = up.parent
"""
QUERIES = {f.__name__: f for f in (op1_url_filter, op2_token_counts, op3_language_id, op4_jaccard_join, op5_topk, op6_toxicity, op7_mixing, op8_decontamination, op9_licenses, op10_token_ids, op11_periodic_runs, op12_prefix_trie, op13_fingerprints)}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": URL_SQL, "op5_topk": TOP_K_SQL, "op9_licenses": LICENSE_SQL, "op12_prefix_trie": TRIE_SQL}
