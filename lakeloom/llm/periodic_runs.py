"""Periodic runs of words: branching tandem tests over an enhanced suffix array.

A block of texts is one row of word numbers; numbers of different texts differ, and each text ends with a number of its own, so
the suffix array of the block is those of its texts side by side. It comes from prefix doubling, whose ranks at each step
(equal ranks: equal stretches of 1, 2, 4, ... words) are kept, since they also give LCP values and common
extensions to the left by binary lifting.

A square `uu` with |u| = d at word i is branching if the words i + d and i + 2d differ. Then i and i + d are in one LCP interval of
depth d, in different children. So for each interval, each suffix i of its children but the largest is tested: is the
rank of i + d, or of i - d, inside the interval and outside the child? That is n log n tests at most. The last square of a run is
branching, so turning each square to the left as far as it goes gives all runs; what two squares give twice, with the
period or a multiple of it, is merged by start and end. There are no tree nodes: an interval is two numbers and a depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import pieces

#: Suffixes that are tested at once.
TESTS = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of equal neighbours begins, and the groups' sizes."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffixes in order, the place of each (its inverse), and for each step k the ranks by the first 2**k words.

    words: every text ends with a number that occurs once. Only suffixes that still share a rank are sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    first, size = _grouped(words[order])
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first, size)
    levels, k = [rank.copy()], 1
    slots = np.flatnonzero(np.repeat(size, size) > 1)
    at = order[slots]
    while len(slots):
        key = rank[at].astype(np.int64) * n + rank[at + k]
        turn = np.argsort(key)
        at = at[turn]
        order[slots] = at
        first, size = _grouped(key[turn])
        rank[at] = np.repeat(slots[first], size)
        levels.append(rank.copy())
        shared = np.repeat(size, size) > 1
        slots, at, k = slots[shared], at[shared], 2 * k
    return order, rank, levels


def common_prefix(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Number of words that the suffixes a and b (a <> b) have in common."""
    off = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        off += (levels[k][a + off] == levels[k][b + off]).astype(np.int64) << k
    return off


def common_suffix(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Number of equal words just before the places a < b."""
    off = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        from_a, from_b = a - off - (1 << k), b - off - (1 << k)
        off += ((from_a >= 0) & (levels[k][np.maximum(from_a, 0)] == levels[k][np.maximum(from_b, 0)])).astype(np.int64) << k
    return off


def lcp_intervals(lcp: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place of `lcp` over 0: the place, and the first and last place of its interval and its depth.

    lcp[j] is that of the suffixes at j - 1 and j. The neighbours with a smaller value are found by a table of minima over
    1, 2, 4, ... places; widest: the largest number of suffixes of one interval.
    """
    here = np.flatnonzero(lcp)
    depth = lcp[here]
    minima = [lcp]
    while 2 << (len(minima) - 1) < 2 * widest and len(minima[-1]) > 1 << (len(minima) - 1):
        half = 1 << (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
    begin, end = here.copy(), here + 1
    for k in range(len(minima) - 1, -1, -1):
        low, step = minima[k], 1 << k
        before = begin - step
        begin = np.where((before >= 0) & (low[np.maximum(before, 0)] >= depth), before, begin)
        inside = end < len(low)
        end = np.where(inside & (low[np.where(inside, end, 0)] >= depth), end + step, end)
    return here, begin - 1, end - 1, depth


def squares(order: np.ndarray, place: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Branching squares: first word and half length, each once."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    same = 1 + np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    lcp[same] = common_prefix(order[same - 1], order[same], levels)
    here, begin, end, depth = lcp_intervals(lcp, int(np.bincount(levels[0], minlength=1).max(initial=1)))
    if not len(here):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = np.argsort(begin * (int(depth.max()) + 1) + depth, kind="stable")
    here, begin, end, depth = here[turn], begin[turn], end[turn], depth[turn]
    first, cuts = _grouped(begin * (int(depth.max()) + 1) + depth)
    # children of an interval: from its begin to the first cut, from cut to cut, and from the last cut to its end
    owner = np.repeat(np.arange(len(first)), cuts + 1)
    child_0 = first + np.arange(len(first))
    child = np.empty(len(owner), np.int64)
    child[child_0] = begin[first]
    child[np.arange(len(here)) + np.repeat(np.arange(len(first)), cuts) + 1] = here
    child_end = np.append(child[1:], 0)
    child_end[child_0 + cuts] = end[first] + 1
    size = child_end - child
    largest = np.flatnonzero(size == np.maximum.reduceat(size, child_0)[owner])
    small = np.ones(len(owner), bool)
    small[largest[_grouped(owner[largest])[0]]] = False
    todo = np.flatnonzero(small)
    before = np.cumsum(size[todo]) - size[todo]
    found = []
    for part in np.split(todo, np.flatnonzero(np.diff(before // TESTS)) + 1):
        times = size[part]
        inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        own = np.repeat(part, times)
        i, d = order[child[own] + inside], depth[first[owner[own]]]
        low, high = begin[first[owner[own]]], end[first[owner[own]]]
        for other in (i + d, i - d):
            at = place[np.maximum(other, 0)]
            hit = (other >= 0) & (at >= low) & (at <= high) & ((at < child[own]) | (at >= child_end[own]))
            found.append(np.minimum(i, other)[hit] * n + d[hit])
    both = np.unique(np.concatenate(found))
    return both // n, both % n


def runs(words: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of at least `least` words and `times` (2 or more) periods: first word, number of words and smallest
    period, by first word, then period. words: as in `suffix_array`."""
    order, place, levels = suffix_array(words)
    i, d = squares(order, place, levels)
    start = i - common_suffix(i, i + d, levels)
    end = i + 2 * d
    turn = np.lexsort((d, end, start))
    start, end, d = start[turn], end[turn], d[turn]
    first = _grouped(start * (len(words) + 1) + end)[0]
    start, length, d = start[first], end[first] - start[first], d[first]
    kept = length >= np.maximum(least, times * d)
    start, length, d = start[kept], length[kept], d[kept]
    turn = np.lexsort((d, start))
    return start[turn], length[turn], d[turn]


def text_runs(texts: list[bytes], least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], list[bytes]]:
    """Of texts: their numbers of words, the text of each run, the runs (`runs`, from each text's first word), and the
    texts with one blank between words and without the words of any run after its first period."""
    numbers, split, used = [], [], 0
    for t in texts:
        words = t.split()  # of bytes: at the blanks \x20 and \x09-\x0D only
        number = dict(zip(dict.fromkeys(words), range(used, used + len(words)), strict=False))
        used += len(number) + 1
        numbers.append(np.fromiter((number[w] for w in words), np.int64, len(words)))
        numbers.append(np.array([used - 1]))
        split.append(words)
    n = np.fromiter(map(len, split), np.int64, len(split))
    offset = np.cumsum(n + 1) - n - 1
    start, length, period = runs(np.concatenate(numbers), least, times) if texts else (np.zeros(0, np.int64),) * 3
    owner = np.searchsorted(offset, start, side="right") - 1
    change = np.zeros(int((n + 1).sum()) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    stays = np.cumsum(change) == 0
    with_runs = set(owner.tolist())
    shorter = [b" ".join([w for w, k in zip(words, stays[o : o + len(words)].tolist(), strict=True) if k] if x in with_runs else words) for x, (words, o) in enumerate(zip(split, offset.tolist(), strict=True))]
    return n, owner, (start - offset[owner], length, period), shorter


def find_runs(docs: DataFrame, keep: dict[str, Column], text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """Periodic runs of each whole text: the columns of `keep`, n_words, runs (first word from 0, words, smallest period;
    by first word, then period) and collapsed, the text without what repeats in its runs.

    A word is a longest stretch without blanks (\\x20, \\x09-\\x0D). A run has at least `least` words and `times` periods, and
    no neighbouring word extends it. One row for each input row: repeated rows have equal results, a null or empty text has no word,
    no run and an empty collapsed text. A task holds blocks of about 2 MB of text, or one text that is longer; there is no shuffle.
    """
    kept = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("_text"))
    names = list(keep)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in pieces(batch, len(names)):
                n, owner, cells, shorter = text_runs([t.encode() for t in texts], least, times)
                begins = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
                values = pa.StructArray.from_arrays([pa.array(c) for c in cells], fields=list(run))
                yield pa.RecordBatch.from_arrays(
                    [*block.columns[:-1], pa.array(n), pa.ListArray.from_arrays(begins, values), pa.array(shorter, pa.binary()).cast(pa.string())], [*names, "n_words", "runs", "collapsed"]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(found, f"{fields}, n_words long, runs {RUNS}, collapsed string")
