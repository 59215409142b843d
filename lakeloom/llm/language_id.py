"""Language identification by bit-sliced Bloom filters over character n-grams.

One filter for each language, all with the same positions, lie side by side: a position holds a mask with one bit for
each language. The AND of the masks at an n-gram's positions is the mask of all languages that (may) contain it, so
one look-up asks every language. Over a text, the set bits are counted for each language; a language whose filter is
filled to share f answers falsely f**hashes of the time, and its count is corrected for that. The largest corrected
count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import pieces, sampled, written
from ._text import mix, randoms

_U = np.uint64
GRAM = 4
POSITIONS = 1 << 18
HASHES = 3
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def letter_grams(texts: list[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the lower-cased texts, and the text of each.

    Any run of other characters than letters counts as one blank; a blank also stands before and after a text. An
    n-gram may begin or end with a blank, but holds none inside.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = 1 + np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    letter = _letters()[codes]
    keep = letter | np.concatenate([[True], letter[:-1]])
    text = np.searchsorted(ends, np.flatnonzero(keep), side="right")
    c = np.where(letter, codes, 0)[keep].astype(_U)
    m = len(c) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total, inside = np.zeros(m, _U), np.ones(m, bool)
    for i, r in enumerate(randoms(n, 23)):
        total += c[i : i + m] * r
        if 0 < i < n - 1:
            inside &= c[i : i + m] != 0
    # a gram that starts with the blank after a text belongs to the next one
    owner = text[1 : m + 1] if n > 1 else text[:m]
    inside &= owner < len(texts)
    return mix(total[inside]), owner[inside]


def positions(grams: np.ndarray, size: int = POSITIONS, hashes: int = HASHES) -> np.ndarray:
    """The filter positions of each n-gram: one row for each hash."""
    return np.stack([(mix(grams + _U(h)) % _U(size)).astype(np.int64) for h in range(hashes)]) if len(grams) else np.zeros((hashes, 0), np.int64)


class LanguageFilters:
    """The learned languages in order, and the mask of languages at each position (64 languages a word)."""

    def __init__(self, langs: list[str], masks: np.ndarray, most_common: str):
        self.langs, self.masks, self.most_common = langs, masks, most_common
        fill = np.array([np.count_nonzero(masks[:, i // 64] >> _U(i % 64) & _U(1)) / len(masks) for i in range(len(langs))])
        self.false = np.minimum(fill**HASHES, 0.999)

    def corrected(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text that each language has, corrected for false answers; and all n-grams of each text."""
        grams, owner = letter_grams(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        at = positions(grams, len(self.masks))
        mask = self.masks[at[0]]
        for row in at[1:]:
            mask = mask & self.masks[row]
        out = np.zeros((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            hits = np.bincount(owner, weights=(mask[:, i // 64] >> _U(i % 64) & _U(1)).astype(float), minlength=len(texts))
            out[:, i] = (hits - n * self.false[i]) / (1 - self.false[i])
        return np.maximum(out, 0), n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. Ties go to the language whose code comes first; texts without a letter, or
        any text when nothing was learned, are `und` with score 0; a text of unknown n-grams gets the language with
        most rows, with score 0."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        counts, n = self.corrected(texts)
        best = counts.argmax(axis=1)
        top = counts[np.arange(len(texts)), best]
        score = np.clip(top / np.maximum(n, 1), 0, 1)
        names = [(self.langs[b] if t > 0 else self.most_common) if has_letter(x) else "und" for b, t, x in zip(best, top, texts, strict=True)]
        return names, np.where(np.array(names, object) == "und", 0.0, score)


def learn_languages(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = 50_000, least: int = 3, share: float = 0.05, languages: int = 4096
) -> LanguageFilters:
    """Filters from labelled rows (null languages and texts are left out).

    rows: about so many rows are learned from at most, drawn row by row whatever their ids and the table's size. languages:
    no more are learned, those with most rows, since each has a bit in every mask and a count on the driver. An n-gram
    enters a language's filter if at least `least` of its rows have it, and if its share of the language's n-grams is
    at least `share` of its largest share in any language: foreign phrases in a few texts don't fill a filter. The
    driver gets the filter alone: at most `POSITIONS` masks, whatever the input.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()}
    if not sizes:
        return LanguageFilters([], np.zeros((POSITIONS, 1), _U), "und")
    langs = sorted(sizes)
    part = min(1.0, rows / sum(sizes.values()))
    labelled = sampled(labelled, part, "languages").select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            for block, texts in pieces(batch, 1):
                known = [number.get(x, -1) for x in block.column(0).to_pylist()]
                texts, lang = [t for t, x in zip(texts, known, strict=True) if x >= 0], [x for x in known if x >= 0]
                grams, owner = letter_grams(texts)
                lang = np.array(lang, np.int64)[owner]
                order = np.lexsort((owner, grams, lang))
                g, o, x = grams[order], owner[order], lang[order]
                first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])) if len(g) else np.zeros(0, np.int64)
                new_doc = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (o[1:] != o[:-1])]) if len(g) else np.zeros(0, bool)
                n = np.diff(np.concatenate([first, [len(g)]]))
                n_docs = np.add.reduceat(new_doc.astype(np.int64), first) if len(g) else n
                yield pa.RecordBatch.from_arrays([pa.array(x[first], pa.int32()), pa.array(g[first].view(np.int64)), pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())], ["lang", "gram", "n", "n_docs"])

    counts = written(labelled.mapInArrow(count, "lang int, gram long, n long, n_docs long").groupBy("gram", "lang").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")))
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    rate = F.col("n") / F.element_at(F.create_map(*[F.lit(v) for k, t in totals.items() for v in (k, float(t))]), F.col("lang")) if totals else F.lit(0.0)
    rated = counts.withColumn("rate", rate)
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rated.join(top, "gram").where((F.col("n_docs") >= F.least(F.lit(least), F.lit(max(1, min(sizes.values()))))) & (F.col("rate") >= share * F.col("top")))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = positions(batch.column(0).to_numpy().view(_U))
            lang = np.tile(batch.column(1).to_numpy(), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array((lang // 64).astype(np.int32)), pa.array((_U(1) << (lang % 64).astype(_U)).view(np.int64))], ["at", "word", "bit"])

    held = kept.select("gram", "lang").mapInArrow(bits, "at long, word int, bit long").groupBy("at", "word").agg(F.bit_or("bit").alias("mask"))
    masks = np.zeros((POSITIONS, -(-len(langs) // 64)), _U)
    found = held.toArrow()
    masks[found["at"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy().view(_U)
    return LanguageFilters(langs, masks, min(langs, key=lambda x: (-sizes[x], x)))


def identify_languages(docs: DataFrame, filters: LanguageFilters, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """Language of each whole text: the columns of `keep`, lang_pred, score (share of the text's n-grams that the
    language has, 0 to 1). One row for each input row; null and empty texts, and texts without a letter, are `und`."""
    kept = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast((filters.langs, filters.masks, filters.most_common))  # a fixed size: POSITIONS masks

    names = list(keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageFilters(*shared.value)
        for batch in batches:
            for block, texts in pieces(batch, len(names)):
                langs, score = own.predict(texts)
                yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(langs, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(predict, f"{fields}, lang_pred string, score double")
