"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; docs is a table of documents as read
from files, and every stage but the last returns the same columns. Ids may be null or repeat: stages decide by row, and a
row's key is its file and its place there. Intermediate tables of a stage are removed when its decisions are written. An empty
table gives an empty result; a null text is never toxic, a duplicate or a leak, and has no words to mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm._bloom import without
from lakeloom.llm._common import columns_of, free_name, held_out, keyed, remove, scratch, shared_dir, text_batches, written
from lakeloom.llm.decontaminate import find_leaks
from lakeloom.llm.jaccard_join import jaccard_join
from lakeloom.llm.mixing import mix_sources
from lakeloom.llm.queries import table, tokenizer_file
from lakeloom.llm.token_ids import token_id_table
from lakeloom.llm.toxicity import learn_toxicity, toxicity_column


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under 0.3, one by one: repeated rows have the same score. Labels of the held-out
    quarter aren't learned from."""
    text_batches(spark)
    model = learn_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return docs.where(toxicity_column(spark, model, "text") < 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: one with the smallest id, or without an id if all of them are."""
    text_batches(spark)
    row = free_name("_row", docs.columns)
    rows = keyed(docs, row)
    with scratch(spark):
        key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
        classes = jaccard_join(rows.select(key.alias("key"), "text"), id_col="key")
        rejected = written(classes.where("key.row <> class_id.row").select(F.col("key.row").alias(row)), keep=True)
    return without(rows, rejected, row).select(*columns_of(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a copy of a benchmark item. Of repeated rows all stay or go."""
    text_batches(spark)
    row = free_name("_row", docs.columns)
    rows = keyed(docs, row)
    with scratch(spark):
        passages = rows.select(F.col(row).alias("key"), "text")
        leaks = written(find_leaks(passages, table(spark, sf_dir, "benchmark"), id_col="key").select(F.col("key").alias(row)).distinct(), keep=True)
    return without(rows, leaks, row).select(*columns_of(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0, 1 or 2 times; repeated rows are drawn apart.

    Most rows are taken, so both sides of the join grow with the table: neither is broadcast at any size.
    """
    text_batches(spark)
    row = free_name("_row", docs.columns)
    turns = free_name("_turns", docs.columns)
    rows = keyed(docs, row)
    with scratch(spark):
        drawn = mix_sources(rows.select("doc_id", "text", "source", F.col(row).alias("key")), keep=("doc_id", "key")).where("times > 0")
        taken = written(drawn.select(F.col("key").alias(row), F.sequence(F.lit(1), "times").alias(turns)), keep=True)
    return rows.join(taken.hint("merge"), row).withColumn(turns, F.explode(turns)).select(*columns_of(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all rows in id order, null ids first, read back: (doc_id, start, n_tokens, ids_crc32), a row for each row."""
    return token_id_table(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("mixing", mix), ("token_ids", encode)]
#: Learned scores, random draws and token ids aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole documents table; every stage's rows are written and read again, and
    removed, with what the stage wrote beside them, when the next stage's are written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark), scratch(spark):  # the outer one has what a stage keeps until its rows are written
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    result = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, last)  # the last stage has written its files
    return result
