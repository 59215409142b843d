"""Fingerprints of documents: bottom-k sketches of shingle hashes, with built-in functions alone.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles, in order; a shingle is five words in a row of the lower-cased
text, or all words of a text with fewer. A word is a longest stretch without blanks (\\x20, \\x09-\\x0D). The sketch of a union is the k
smallest hashes of its parts' sketches, so sketches merge in any order. Under k hashes a sketch is the whole set, and all
estimates are exact; else resemblance has a standard error of sqrt(j * (1 - j) / k), 0.044 at most for k = 128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name, keyed, numbered, written

SHINGLE = 5
K = 128
BLANKS = " \t\n\x0b\f\r"


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def sketch(text: Column, k: int = K) -> Column:
    """Bottom-k sketch of a text: an array of longs; empty for a null text and one without words."""
    plain = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))

    def shingles(words: Column) -> Column:
        n = F.size(words)
        rows = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, SHINGLE)]))
        return F.when(n < SHINGLE, F.array(F.xxhash64(words))).otherwise(F.slice(rows, 1, F.greatest(n - SHINGLE + 1, F.lit(1))))

    hashes = _let(F.transform(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)), shingles)
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, k))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity of two sketched sets, 0 to 1; 1 for two empty ones."""
    return _let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's set that b's set has; 1 for an empty a.

    Of a's hashes among the k smallest of both, those that are b's: with a small a beside a large b few are left, and the
    estimate is null if there is none.
    """

    def share(own: Column) -> Column:
        return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own))

    return F.when(F.size(a) == 0, 1.0).otherwise(_let(F.array_intersect(merged(a, b, k), a), share))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below k."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def from_text(text: Column) -> Column:
    """The sketch that `as_text` gave."""
    parts = F.sequence(F.lit(0), F.greatest(F.length(text) / 16 - 1, F.lit(0)).cast("int"))
    # the top half is signed, so it is put together from two halves
    half = lambda p, at: F.conv(F.substring(text, p * 16 + at, F.lit(8)), 16, 10).cast("long")
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(parts, lambda p: F.shiftleft(half(p, 1), 32).bitwiseOR(half(p, 9))))


def merge_sketches(sketches: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """(by, column): the sketch of each group's union; rows with a null sketch count as empty, a null group is a group.

    Hashes become rows, and equal ones of a group are counted once on both sides of the shuffle; then only a group's k smallest of each task are
    shuffled and ranked, so a group of any size leaves k hashes for each task.
    """
    hashes = sketches.select(*by, F.explode_outer(column).alias("_hash")).distinct()
    first = Window.partitionBy(*by).orderBy(F.col("_hash").asc_nulls_last())
    best = hashes.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k)
    return best.groupBy(*by).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "sketch", k: int = K) -> DataFrame:
    """docs with the sketch of each whole text in a column `name`: one scan, no shuffle, no Python."""
    return docs.withColumn(name, sketch(F.col(text_col), k))


def with_next(docs: DataFrame, id_col: str, text_col: str, k: int = K) -> DataFrame:
    """(id, text, next_id, head, next_sketch) of each row: head is the first third (as many code points as a third of the row's own
    text, rounded down) of the next row's text, by descending id; after the last comes the first.

    Null ids come last; rows with equal ids are in an order of their texts' hashes, so each row has one next row. A row's key is
    its file and its place there. Only keys, ids and lengths are sorted; each text is shuffled once, and its head once more with the
    sketch. A row's own sketch isn't shuffled: where it is needed, its text is at hand.
    """
    key = free_name("_key", docs.columns)
    rows = keyed(docs, key).select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    narrow = rows.select("key", "id", F.length("text").alias("n"), F.xxhash64("text").alias("tie"))
    order = written(numbered(narrow, [F.col("id").desc_nulls_last(), F.col("tie"), F.col("key")], "at").select("key", "n", "at"))
    last = order.count() - 1
    before = order.select(F.col("key").alias("to"), F.floor(F.col("n") / 3).cast("int").alias("take"), F.when(F.col("at") == last, F.lit(0).cast("long")).otherwise(F.col("at") + 1).alias("at"))
    links = order.select("key", "at").join(before, "at").select("key", "to", "take")
    heads = rows.join(links, "key").select(F.col("to").alias("key"), F.col("id").alias("next_id"), F.substring("text", F.lit(1), F.col("take")).alias("head"), sketch(F.col("text"), k).alias("next_sketch"))
    return rows.join(heads, "key").drop("key")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is that of `with_next`: (id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id). A null text is empty; one row for each row."""
    pairs = with_next(docs, id_col, text_col, k)
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    both = pairs.select("id", n.cast("long").alias("n_chars"), sketch(F.col("text"), k).alias("sketch"), "next_id", "next_sketch", F.sha2(edited, 256).alias("edited_sha256"), sketch(edited, k).alias("edited_sketch"))
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"), "next_id",
    )
