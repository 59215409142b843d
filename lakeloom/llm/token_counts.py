"""Token counts of whole texts without their ids.

White space parts every pre-token of a tokenizer that drops it, so a text's count is the sum over its pre-tokens of
how often each occurs, times how many pieces it has. A block of documents gives one row for each of its pre-tokens:
the documents that have it, and how often. An exchange and sort bring all rows of a pre-token together, where its
pieces are counted once and merge-joined to its rows; every task adds up the products by document, and the blocks'
sums meet in a second, small exchange. No pre-token has more rows than there are blocks, so none is a hot key.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces

#: A pre-token of at least this share of a block's documents is counted in the block, so no join key is very frequent.
FREQUENT = 1 / 64
# Unicode white space; Python's split() has U+001C to U+001F besides.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_TOKENIZERS: dict = {}


def _tokenizer(file: str):
    if file not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[file] = t = Tokenizer.from_file(file)
        t.no_truncation()
        t.no_padding()
    return _TOKENIZERS[file]


def count_pieces(pretokens: list[str], file: str) -> list[int]:
    """Pieces of each pre-token, as the library gives them, without added special tokens."""
    return [len(e.ids) for e in _tokenizer(file).encode_batch_fast(pretokens, add_special_tokens=False)]


def split_text(text: str) -> list[str]:
    """The white-space-separated pre-tokens of a text."""
    return [x for x in _SPACE.split(text) if x] if _SEPARATORS.search(text) else text.split()


@cache
def _ends_with_letter(letter: str, file: str) -> bool:
    """Is the last character of this letter, as the tokenizer normalises it, a letter? U+0130 gives an i and a combining dot,
    and a combining mark goes with what follows it."""
    normalizer = _tokenizer(file).normalizer
    return (normalizer.normalize_str(letter) if normalizer else letter)[-1:].isalpha()


def parted(pretoken: str, file: str) -> tuple[str, str]:
    """A word and the full stop or comma after it, where that is a pre-token of its own; else the pre-token and nothing."""
    apart = pretoken[-1] in ".," and pretoken[-2:-1].isalpha() and _ends_with_letter(pretoken[-2], file)
    return (pretoken[:-1], pretoken[-1]) if apart else (pretoken, "")


def _postings(texts: list[str], file: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of the texts, where each one's entries begin, entries (text << 8 | times), and tokens counted at once.

    Counted at once are pre-tokens of at least FREQUENT of the texts, full stops and commas after words, and what
    exceeds 255 in a text.
    """
    seen: dict[str, int] = {}
    of, times, whose = [], [], []
    for text in texts:
        own = Counter(split_text(text))
        of += [seen.setdefault(x, len(seen)) for x in own]
        times += own.values()
        whose.append(len(own))
    counted = np.zeros(len(texts), np.int64)
    if not seen:
        return [], np.zeros(1, np.int64), np.zeros(0, np.uint32), counted
    of, times, text = np.array(of, np.int64), np.array(times, np.int64), np.repeat(np.arange(len(texts)), whose)
    bits = [parted(x, file) for x in seen]
    dot, comma = count_pieces([".", ","], file)
    end = np.array([{"": 0, ".": dot, ",": comma}[e] for _, e in bits], np.int64)
    counted += np.bincount(text, weights=times * end[of], minlength=len(texts)).astype(np.int64)
    base: dict[str, int] = {}
    of = np.array([base.setdefault(b, len(base)) for b, _ in bits], np.int64)[of]
    names = np.array(list(base), object)
    order = np.lexsort((text, of))
    of, text, times = of[order], text[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (text[1:] != text[:-1])]))
    of, text, times = of[first], text[first], np.add.reduceat(times, first)
    hot = np.bincount(of) >= max(2, FREQUENT * len(texts))
    now = np.where(hot[of], times, np.maximum(times - 255, 0))
    some = np.flatnonzero(now)
    which, at = np.unique(of[some], return_inverse=True)
    sizes = np.array(count_pieces(list(names[which]), file), np.int64)
    counted += np.bincount(text[some], weights=now[some] * sizes[at], minlength=len(texts)).astype(np.int64)
    rest = ~hot[of]
    entries = (text[rest] << 8 | np.minimum(times[rest], 255)).astype("<u4")
    return list(names[~hot]), np.concatenate([[0], np.cumsum(np.bincount(of[rest], minlength=len(names))[~hot])]), entries, counted


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each text: (id, n_bytes, n_tokens, over_limit).

    tokenizer_file: of a tokenizer of the `tokenizers` library that drops white space between pre-tokens. Special
    strings inside texts count as the library's default has them. n_bytes: of the UTF-8 text; null and empty texts
    have 0 bytes and 0 tokens. One row for each input row: repeated and null ids stay apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block, texts in pieces(batch, 1, 8_000_000):
                names, begins, entries, counted = _postings(texts, tokenizer_file)
                n = len(names)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * begins).astype(np.int32)), pa.py_buffer(entries)])
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array(names, pa.string()), raw], ["block", "pretoken", "entries"])
                sizes = pc.fill_null(pc.binary_length(block.column(1)), 0).cast(pa.int64())
                own = pa.RecordBatch.from_arrays([block.column(0), sizes, pa.array(counted)], [id_col, "n_bytes", "counted"])
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, own.schema) as stream:
                    stream.write_batch(own)
                packed = out.getvalue().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.array([packed], pa.binary())], ["block", "pretoken", "entries"])
                number += 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        held, last, last_size = 0, None, 0

        def told() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([False] * len(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "documents", "packed"])
            sums.clear()
            held = 0
            return out

        for batch in batches:
            whole = pc.is_null(batch.column(1))
            own = batch.filter(whole)
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([True] * own.num_rows, pa.bool_()), own.column(2)], ["block", "documents", "packed"])
            rows = batch.filter(pc.invert(whole))
            if not rows.num_rows:
                continue
            coded = rows.column(1).dictionary_encode()  # the batch is sorted: each pre-token is one run
            names = coded.dictionary.to_pylist()
            sizes = np.array([last_size, *count_pieces(names[1:], tokenizer_file)] if names[0] == last else count_pieces(names, tokenizer_file), np.int64)
            last, last_size = names[-1], int(sizes[-1])
            length = pc.binary_length(rows.column(2)).to_numpy() // 4
            flat = np.frombuffer(b"".join(rows.column(2).to_pylist()), "<u4").astype(np.int64)
            product = (flat & 255) * np.repeat(sizes[coded.indices.to_numpy()], length)
            blocks, of = np.unique(rows.column(0).to_numpy(), return_inverse=True)
            of = np.repeat(of, length)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(len(blocks) + 1))
            for number, a, b in zip(blocks.tolist(), cuts[:-1], cuts[1:], strict=True):
                mine = order[a:b]
                add = np.bincount(flat[mine] >> 8, weights=product[mine]).astype(np.int64)
                before = sums.get(number, add[:0])
                long, short = (add, before) if len(add) >= len(before) else (before, add)
                long[: len(short)] += short
                held += len(long) - len(before)
                sums[number] = long
            if held > 4_000_000:
                yield told()
        if sums:
            yield told()

    def total(table: pa.Table) -> pa.Table:
        documents = table.column("documents").to_pylist()
        packed = table.column("packed").to_pylist()
        own = pa.ipc.open_stream(packed[documents.index(True)]).read_all()
        tokens = own.column("counted").to_numpy().copy()
        for is_own, raw in zip(documents, packed, strict=True):
            if not is_own:
                add = np.frombuffer(raw, np.int64)
                tokens[: len(add)] += add
        return pa.table([own.column(0), own.column("n_bytes"), pa.array(tokens), pa.array(tokens > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(id_col, text_col).mapInArrow(block_rows, "block long, pretoken string, entries binary")
    dealt = rows.repartition(F.coalesce("pretoken", F.col("block").cast("string"))).sortWithinPartitions("pretoken")
    sums = dealt.mapInArrow(merge, "block long, documents boolean, packed binary")
    return sums.groupBy("block").applyInArrow(total, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
