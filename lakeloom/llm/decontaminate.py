"""Benchmark decontamination: rare word pairs as seeds join passages to test items, Smith-Waterman alignment scores them.

A seed is a pair of words that are neighbours or have one word between them; how far apart they are isn't part of it.
An alignment of M matches and E errors scores 2M - E. If it has `least` of an item of m words, E is at most 2(M - least m),
so of its M - 1 steps from match to match at most M - least m have two errors or more, and ceil(least m) - 1 steps have one
at most. Each of those is a pair that item and passage share, and each begins at another word of the item. An item has
m - 1 words that a pair begins at, so any m - ceil(least m) + HITS of them include HITS such words: no choice loses a pair
of document and item, and the rarest ones make the least work.

1. The pairs of the items are counted over all documents; this only orders them by rarity.
2. The pairs at each item's rarest words are its seeds.
3. Where a document holds enough of them near each other is a passage; passages and items are joined on the seeds.
4. Each item is aligned word by word with the passages where it has HITS words or more; the score is the share of the best
   that a whole copy of the item gets.
Items of one to three words have no pairs to spare: they are found where a text has all their words in a row, by an
equi-join of such runs, with the score 1.
Only a Bloom filter of the pairs is broadcast, 64 bits for each and 2**30 bits at most; whatever it lets through
wrongly is lost in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bloom import bloom, in_bloom
from ._common import pieces, scratch, written
from ._text import mix, randoms, shingles, word_hashes

_U = np.uint64
LEAST_WORDS = 4
HITS = 3
MATCH, MISS, GAP = 2, -1, -1


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its passage, as a share of the item's score with itself.

    All pairs advance together, one item word at a time; the gap along the passage is a running maximum.
    """
    m, n = max(map(len, items), default=0), max(map(len, passages), default=0)
    best = np.zeros(len(items), np.int32)
    if not m or not n:
        return best.astype(float)
    a, b = np.zeros((len(items), m), _U), np.ones((len(items), n), _U)
    lengths = np.array([len(x) for x in items])
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)] = x
        b[i, : len(y)] = y
    inside = np.arange(n)[None, :] < np.array([len(y) for y in passages])[:, None]
    slope = np.arange(n, dtype=np.int32) * -GAP
    before = np.zeros((len(items), n + 1), np.int32)
    for j in range(m):
        same = (a[:, j : j + 1] == b) & inside
        now = np.maximum(before[:, :-1] + np.where(same, MATCH, MISS), before[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        now[j >= lengths] = 0
        best = np.maximum(best, now.max(axis=1))
        before[:, 1:] = now
    return best / (MATCH * np.maximum(lengths, 1))


def close_pairs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all pairs of words of one text that are neighbours, then of those with one word between them: hash, index
    of the text, index of the first word."""
    first, second = randoms(2, 13)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = []
    for far in (1, 2):
        at = np.flatnonzero(text[:-far] == text[far:])
        found.append((mix(words[at] * first + words[at + far] * second), text[at], at))
    hashes, owner, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return hashes, owner, at


def _near_others(owner: np.ndarray, at: np.ndarray, reach: int, least: int) -> np.ndarray:
    """Which of the words (sorted by text and place, distinct) are among `least` of one text within `reach` words."""
    kept = np.zeros(len(at), bool)
    n = len(at) - least + 1
    if n > 0:
        first = np.flatnonzero((owner[:n] == owner[least - 1 :]) & (at[least - 1 :] - at[:n] <= reach))
        for i in range(least):
            kept[first + i] = True
    return kept


def _run(words: np.ndarray) -> int:
    """Hash of all the words in a row."""
    return int(shingles(words, np.array([0, len(words)]), len(words))[0].view(np.int64)[0])


def _whole_copies(docs: DataFrame, short: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """(id, item id, score 1) of texts with all words of an item in a row; short: (item id, size, whole)."""
    sizes = sorted(r.size for r in short.select("size").distinct().collect())  # 1 to LEAST_WORDS - 1
    filters = docs.sparkSession.sparkContext.broadcast(bloom(short.select(F.col("whole").alias("gram"))))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block, texts in pieces(batch, 1):
                words, offsets = word_hashes(texts)
                for size in sizes:
                    hashes, owner, _ = shingles(words, offsets, size)
                    hit = in_bloom(hashes, *filters.value)
                    owner, hashes = np.unique(np.stack([owner[hit], hashes[hit].view(np.int64)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(number + owner), block.column(0).take(pa.array(owner)), pa.array(np.full(len(owner), size, np.int32)), pa.array(hashes)], ["doc", id_col, "size", "whole"])
                number += len(texts)

    return docs.select(id_col, text_col).mapInArrow(runs, f"doc long, `{id_col}` {kind}, size int, whole long").join(short, ["size", "whole"])


def pair_counts(docs: DataFrame, grams: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n_found) of how often each pair of grams(gram) occurs in all texts; pairs that occur in none have no row,
    and the filter lets a few others through."""
    all_bloom = docs.sparkSession.sparkContext.broadcast(bloom(grams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for _, texts in pieces(batch, 0):
                hashes = close_pairs(*word_hashes(texts))[0]
                hit = in_bloom(hashes, *all_bloom.value)
                for g, n in zip(*(x.tolist() for x in np.unique(hashes[hit], return_counts=True)), strict=True):
                    total[g] = total.get(g, 0) + n
                if len(total) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), _U).view(np.int64)), pa.array(list(total.values()), pa.int64())], ["gram", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), _U).view(np.int64)), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    return docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n_found"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents with a copy of a test item, exact or edited: (id, item, score), score >= least.

    One row for each input row and item, with the best score of any part of the text (1 for a whole exact copy). Words are
    as in word_hashes. Null, empty and wordless texts are in no pair; an item that appears in several rows counts as several
    items with the same id, and repeated or null document ids stay apart by row. All pairs are found whose item has
    LEAST_WORDS words or more, and more than 1 / least; of a shorter item, all whole copies.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    sc = docs.sparkSession.sparkContext

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block, texts in pieces(batch, 1):
                words, offsets = word_hashes(texts)
                own = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                grams = [close_pairs(w, np.array([0, len(w)]))[0].view(np.int64).tolist() if len(w) >= LEAST_WORDS else [] for w in own]
                whole = [_run(w) if 0 < len(w) < LEAST_WORDS else None for w in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(texts))), block.column(0), pa.array([len(w) for w in own], pa.int32()), pa.array([w.tobytes() for w in own], pa.binary()), pa.array(grams, pa.list_(pa.int64())), pa.array(whole, pa.int64())], ["item", item_col, "size", "words", "grams", "whole"])
                number += len(texts)

    items = written(benchmark.select(item_col, item_text_col).mapInArrow(item_rows, f"item long, `{item_col}` {item_kind}, size int, words binary, grams array<long>, whole long"))
    steps = F.greatest(F.lit(0), F.ceil(F.col("size") * F.lit(least) - 1e-9).cast("int") - 1)
    items = items.withColumn("steps", steps).withColumn("hits", F.least(F.lit(HITS), F.greatest(F.lit(1), F.col("steps"))))

    def span(size: int) -> int:
        """The most words of a text that a part scoring `least` of an item can have."""
        return int(np.ceil(size * (3 - 2 * least))) + 2

    short = items.where("whole IS NOT NULL").select("item", item_col, "size", "whole")
    longest, fewest = items.where(F.col("size") >= LEAST_WORDS).agg(F.max("size"), F.min("hits")).first()
    reach, fewest = span(longest or 0), fewest or 1
    grams = items.select("item", "size", "steps", "hits", F.posexplode("grams").alias("at", "gram")).withColumn("at", F.col("at") % (F.col("size") - 1))
    spread = pair_counts(docs, grams, text_col)
    rarity = grams.join(spread, "gram", "left").groupBy("item", "at").agg(F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_found"))
    place = F.row_number().over(Window.partitionBy("item").orderBy("n_found", "at"))
    starts = rarity.withColumn("place", place)
    seeds = written(grams.join(starts, ["item", "at"]).where(F.col("place") < F.col("size") - F.col("steps") + F.col("hits")).select("item", "hits", "at", "gram").distinct())
    seed_bloom = sc.broadcast(bloom(seeds))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        row = number
        for batch in batches:
            for block, texts in pieces(batch, 1):
                words, offsets = word_hashes(texts)
                hashes, owner, at = close_pairs(words, offsets)
                hit = in_bloom(hashes, *seed_bloom.value)
                hit = hit[np.argsort(at[hit], kind="stable")]
                place, first = np.unique(at[hit], return_index=True)
                near = _near_others(owner[hit[first]], place, reach, fewest)
                hit = hit[np.isin(at[hit], place[near])]
                whose, where = owner[hit], at[hit]
                if len(hit):
                    far = np.flatnonzero((whose[1:] != whose[:-1]) | (where[1:] - where[:-1] > reach)) + 1
                    begins, ends = np.concatenate([[0], far]), np.concatenate([far, [len(hit)]])
                    doc = whose[begins]
                    lo, hi = np.maximum(where[begins] - reach, offsets[doc]), np.minimum(where[ends - 1] + 1 + reach, offsets[doc + 1])
                    n = len(begins)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(number, number + n)), pa.array(row + doc), block.column(0).take(pa.array(doc)),
                            pa.array([words[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
                            pa.array([hashes[hit[a:b]].view(np.int64).tolist() for a, b in zip(begins, ends, strict=True)], pa.list_(pa.int64())),
                            pa.array([(where[a:b] - x).tolist() for a, b, x in zip(begins, ends, lo, strict=True)], pa.list_(pa.int32())),
                        ],
                        ["passage", "doc", id_col, "text", "grams", "places"],
                    )
                    number += n
                row += len(texts)

    found = written(docs.select(id_col, text_col).mapInArrow(passages, f"passage long, doc long, `{id_col}` {kind}, text binary, grams array<long>, places array<int>"))
    held = found.select("passage", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("passage", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    pairs = held.join(seeds, "gram").groupBy("passage", "item", "hits").agg(F.count_distinct("at").alias("n"), F.collect_list("at").alias("ats"), F.collect_list("place").alias("places")).where("n >= hits")
    both = pairs.join(found.drop("grams", "places"), "passage").join(items.select("item", item_col, "words"), "item").select("doc", id_col, "item", item_col, "words", "text", "hits", "ats", "places")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items_of, texts_of, hits, ats, places = (batch.column(c).to_pylist() for c in ("words", "text", "hits", "ats", "places"))
            whose, parts = [], []
            for i, text in enumerate(texts_of):
                reach_of = span(len(items_of[i]) // 8)
                order = np.argsort(places[i], kind="stable")
                place, at = np.array(places[i])[order], np.array(ats[i])[order]
                far = np.flatnonzero(np.diff(place) > reach_of) + 1
                for a, b in zip([0, *far.tolist()], [*far.tolist(), len(place)], strict=True):
                    if len(np.unique(at[a:b])) >= hits[i]:
                        whose.append(i)
                        parts.append(np.frombuffer(text, _U)[max(0, place[a] - reach_of) : place[b - 1] + 1 + reach_of])
            size = np.array([len(x) for x in parts], np.int64)
            order = np.argsort(size, kind="stable")
            score = np.zeros(batch.num_rows)
            begin = 0
            while begin < len(order):
                end = begin + 1
                while end < len(order) and end - begin < 256 and int(size[order[end]]) * (end + 1 - begin) < 1_000_000:
                    end += 1
                own = [whose[j] for j in order[begin:end]]
                np.maximum.at(score, own, align([np.frombuffer(items_of[i], _U) for i in own], [parts[j] for j in order[begin:end]]))
                begin = end
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", id_col, "item", item_col)), pa.array(score)], ["doc", id_col, "item", item_col, "score"])

    scored = both.mapInArrow(scores, f"doc long, `{id_col}` {kind}, item long, `{item_col}` {item_kind}, score double")
    out = scored.where(F.col("score") >= least).groupBy("doc", id_col, "item", item_col).agg(F.max("score").alias("score")).drop("doc", "item")
    if short.isEmpty():
        return out
    return out.union(_whole_copies(docs, short, id_col, text_col, kind).select(id_col, item_col, F.lit(1.0).alias("score")))
