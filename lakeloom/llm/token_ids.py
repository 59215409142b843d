"""Token ids in word-aligned files: Simple-8b words with per-block offsets, written and read by Spark.

Format `s8b1`. A folder of Parquet files is the envelope (any store that Spark writes to, committed once per task);
each row is a block of whole documents:
  part, block      the writing task's place in id order, and the block's place in the task
  first            number of ids of the same part before the block
  doc_ids, counts  the documents of the block in order, and how many ids each has: the offsets inside the block
  ranks, n_ranks   words of the block's most frequent ids (4,096 at most), most frequent first: the i-th has the code i,
                   and any other id the code n_ranks + id
  words            64-bit little-endian words
A word's top 4 bits are a selector; it says how many codes of how many bits lie in the low 60 bits, first code lowest.
Selector 15 is the escape: one code of 60 bits. A word that the block's end leaves partly filled holds zeros; counts
tell how many codes are real.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces, shared_dir, text_batches

_U = np.uint64
# Codes in a word, for selectors 2 to 15 (0 and 1, runs of zeros, aren't used); each takes 60 // n bits.
PER_WORD = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [60 // n for n in PER_WORD]
BLOCK_IDS = 65_536
MOST_RANKS = 4_096


def encode_words(codes: np.ndarray) -> np.ndarray:
    """Codes below 2**60 as 64-bit words, each filled with as many codes as fit (greedy)."""
    n = len(codes)
    if not n:
        return np.zeros(0, "<u8")
    most = int(codes.max())
    if most >> 60:
        raise ValueError("a code needs more than 60 bits")
    limits = np.array([(1 << w) - 1 for w in WIDTHS], _U)
    codes = codes.astype(_U)
    if most < 1 << 20:  # the narrowest selector of each code, by a table where that is small
        need = np.searchsorted(limits, np.arange(most + 1, dtype=_U)).astype(np.int8)[codes.astype(np.int64)]
    else:
        need = np.searchsorted(limits, codes).astype(np.int8)
    # choice[i]: the narrowest selector s with need <= s over the PER_WORD[s] codes from i, or up to the end
    top = {1: np.concatenate([need, np.zeros(64, np.int8)])}  # the largest need of so many codes from each
    for w in (2, 4, 8, 16, 32):
        half = top[w // 2]
        top[w] = half.copy()
        np.maximum(half[: -(w // 2)], half[w // 2 :], out=top[w][: -(w // 2)])
    choice = np.zeros(n, np.int8)  # what fits a selector also fits all wider ones
    for s, w in enumerate(PER_WORD[:-1]):
        p = 1 << (w.bit_length() - 1)
        choice += np.maximum(top[p][:n], top[p][w - p : w - p + n]) > s
    jump = np.array(PER_WORD)[choice]
    starts, i, steps = [], 0, jump.tolist()
    while i < n:
        starts.append(i)
        i += steps[i]
    at = np.array(starts, np.int64)
    selector = choice[at]
    words = (selector.astype(_U) + _U(2)) << _U(60)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        for j in range(PER_WORD[s]):
            inside = rows[at[rows] + j < n] if at[rows[-1]] + j >= n else rows
            words[inside] |= codes[at[inside] + j] << _U(j * WIDTHS[s])
    return words.astype("<u8")


def decode_words(words: np.ndarray, n: int) -> np.ndarray:
    """The first n codes of the words; all words of one selector are unpacked together."""
    words = words.astype(_U)
    selector = (words >> _U(60)).astype(np.int64) - 2
    if len(words) and (selector.min() < 0 or selector.max() >= len(PER_WORD)):
        raise ValueError("a word has a selector that isn't used")
    held = np.array(PER_WORD)[selector] if len(words) else np.zeros(0, np.int64)
    at = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), _U)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        low = _U((1 << WIDTHS[s]) - 1)
        for j in range(PER_WORD[s]):
            out[at[rows] + j] = (words[rows] >> _U(j * WIDTHS[s])) & low
    return out[:n]


# Fixed values of byte-level vocabularies: visible Latin-1 characters stand for themselves, other bytes for 256, 257 ...
_SIGNS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: b for b in _SIGNS} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_SIGNS}))}


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them.

    Byte-level BPE breaks a text before each space that a visible character follows and around each line feed, as long
    as at most two white-space characters stand together; so the ids of these bits are remembered and joined. The bits of
    many texts are made distinct first, and each is looked up once. A text with longer runs, two at its end, other white
    space, or a special token's first characters goes to the library whole.
    """

    other_space = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    runs = re.compile(r"[ \n][ \n](?:[ \n]|\Z)")

    def __init__(self, file: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}  # what was met lately, and before that: bits that are met again move up
        self.earlier: dict[str, bytes] = {}
        self.most = most
        self.ends = dict(zip(".,", self._library([".", ","]), strict=True))

    def whole(self, text: str) -> bool:
        """Does the text go to the library as a whole?"""
        pair = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        return "<|" in text or bool(self.other_space.search(text)) or pair and bool(self.runs.search(text))

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, bit: str) -> bytes | None:
        """Ids of a run of letters, maybe after a space: one pre-token, which goes straight to the merges. None for others."""
        if not (bit[1:] if bit[:1] == " " else bit).isalpha():
            return None
        ids = [t.id for t in self.tokenizer.model.tokenize(bit.encode().decode("latin-1").translate(BYTE_SIGNS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, bits: list[str]) -> None:
        """Remember the ids of bits that were not met lately."""
        known, earlier, others = self.known, self.earlier, []
        for bit in bits:
            ids = earlier.get(bit)
            if ids is None and bit[-1:] in self.ends and bit[-2:-1].isalpha():  # a full stop or comma after a letter is a pre-token of its own
                word = bit[:-1]
                own = known.get(word) or earlier.get(word) or self._word(word)
                if own is not None:
                    known[word] = own
                    ids = own + self.ends[bit[-1]]
            elif ids is None:
                ids = self._word(bit)
            if ids is None:
                others.append(bit)
            else:
                known[bit] = ids
        known.update(zip(others, self._library(others), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        alone = [i for i, text in enumerate(texts) if self.whole(text)]
        marked = [(x.replace("\n", "\r\n\r") if "\n" in x else x).replace(" ", "\r ") for x in texts]
        for i in alone:
            marked[i] = ""
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), "\r")
        coded = lists.values.dictionary_encode()
        bits = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = list(map(self.known.get, bits))
        if None in own:
            self._learn([b for b, ids in zip(bits, own, strict=True) if ids is None])
            own = list(map(self.known.get, bits))
            if len(self.known) > self.most:
                self.known, self.earlier = {}, self.known
        held = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids = np.frombuffer(b"".join(own), "<u4")
        place = coded.indices.to_numpy()
        n = held[place]
        stops = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.repeat((np.cumsum(held) - held)[place] - stops[:-1], n) + np.arange(stops[-1])]
        stops = stops[lists.offsets.to_numpy()]
        if not alone:
            return ids, np.diff(stops)
        parts = [ids[x:y] for x, y in zip(stops[:-1], stops[1:], strict=True)]
        for i, x in zip(alone, self._library([texts[i] for i in alone]), strict=True):
            parts[i] = np.frombuffer(x, "<u4")
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One for each Python worker."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def _codes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent ids, and all ids' codes."""
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    ranks = used[np.argsort(-counts[used], kind="stable")][:MOST_RANKS]
    code = np.arange(len(counts), dtype=np.int64) + len(ranks)
    code[ranks] = np.arange(len(ranks))
    return ranks, code[ids]


def write_token_ids(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each followed by end_id, in ascending id order (null ids first) to a new folder.

    A null or empty text has end_id alone. Documents with the same id lie beside each other, in the order of a hash of
    their text. The range exchange balances ids; a very long text makes a block of its own.
    """
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, coder, key_type = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer_file), None
        held: list[tuple] = []  # (ids, keys, counts) of the block that isn't full yet

        def row() -> pa.RecordBatch:
            nonlocal block, first
            ids, counts = (np.concatenate([x[i] for x in held]) for i in (0, 2))
            keys = [k for x in held for k in x[1]]
            ranks, codes = _codes(ids)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([keys], pa.list_(key_type)), pa.array([counts], pa.list_(pa.int64())), pa.array([encode_words(ranks).tobytes()], pa.binary()), pa.array([len(ranks)], pa.int32()), pa.array([encode_words(codes).tobytes()], pa.binary())],
                ["part", "block", "first", "doc_ids", "counts", "ranks", "n_ranks", "words"],
            )
            block, first = block + 1, first + len(ids)
            held.clear()
            return out

        for batch in batches:
            key_type = batch.schema.field(0).type
            for part_batch, texts in pieces(batch, 1, 6_000_000):
                keys, (ids, counts) = part_batch.column(0).to_pylist(), coder.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                counts = counts + 1
                stops = np.cumsum(counts)
                begin = base = 0
                while begin < len(keys):
                    need = BLOCK_IDS - sum(len(x[0]) for x in held)
                    end = min(int(np.searchsorted(stops, base + need)) + 1, len(keys))
                    held.append((ids[base : stops[end - 1]], keys[begin:end], counts[begin:end]))
                    if stops[end - 1] >= base + need:
                        yield row()
                    begin, base = end, int(stops[end - 1])
        if held:
            yield row()

    # rows with one id and text may come in any order: their places in the input part them, so no key is hot
    order = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("place")]
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("place"))
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.col("key").alias(id_col), "text")
        .mapInArrow(encode, f"part int, block long, first long, doc_ids array<{kind.simpleString()}>, counts array<long>, ranks binary, n_ranks int, words binary")
        .write.option("compression", "none")
        .parquet(path)
    )


def read_token_ids(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of a folder of write_token_ids: (id, start, n_tokens, ids_crc32).

    start: ids of all documents before it. ids_crc32: unsigned crc32 of its ids as little-endian unsigned 32-bit
    integers. Blocks hold all that their decoding takes, so they may be read by any task in any order.
    """
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    held = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    parts, total = [], 0
    for part, n in sorted(blocks.groupBy("part").agg(F.sum(held)).collect()):  # a row for each writing task
        parts.append((part, total))
        total += n
    before = F.broadcast(spark.createDataFrame(parts, "part int, before long"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, keys, counts, ranks, n_ranks, words = (batch.column(c)[i] for c in range(6))
                n = np.array(counts.as_py(), np.int64)
                table = decode_words(np.frombuffer(ranks.as_py(), "<u8"), n_ranks.as_py()).astype("<u4")
                codes = decode_words(np.frombuffer(words.as_py(), "<u8"), int(n.sum())).astype("<u4")
                ids = codes - np.uint32(len(table))
                common = codes < len(table)
                ids[common] = table[codes[common]]
                stops = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (b - a) : 4 * b]) for a, b in zip(n.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(first.as_py() + stops - n), pa.array(n), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    joined = blocks.join(before, "part").select((F.col("first") + F.col("before")).alias("first"), "doc_ids", "counts", "ranks", "n_ranks", "words")
    return joined.mapInArrow(decode, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def token_id_table(docs: DataFrame, tokenizer_file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts as token ids to a new folder of the shared one, and read the documents back from it."""
    text_batches(docs.sparkSession)
    path = shared_dir(docs.sparkSession)
    write_token_ids(docs, tokenizer_file, path, end_id, id_col, text_col)
    return read_token_ids(docs.sparkSession, path, id_col)
