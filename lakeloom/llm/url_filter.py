"""URL filter: glob rules simulated together by one bit-parallel automaton.

A rule (host, path) stands for two globs over the canonical URL host + path: `host path**` and `*.host path**`.
Each glob takes one start bit and one bit for each byte; all globs lie side by side in 64-bit words, longest rule
first. Reading byte c sends the state D to ((D << 1) & B[c]) | (D & L[c]): B marks the bits whose byte is c, L the
bits followed by a wildcard that c may extend (`*` stops at '/', `**` doesn't). One step moves all globs of all URLs
of a batch; at the end of a URL its lowest set accepting bit is the longest rule that fits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U = np.uint64
PACK = 16  # bytes between looks for URLs that are decided
FEW = 8  # URLs that are left to single steps


def globs_of(host: str, path: str) -> list[str]:
    """The globs of a rule: its host, and all subdomains of it. An empty host fits every host."""
    return [f"{host}{path}**", f"*.{host}{path}**"] if host else [f"*{path}**"]


class GlobSet:
    """Globs packed into words. `*` stands for any bytes but '/', `**` for any bytes; the first glob of several that fit wins."""

    def __init__(self, globs: list[str]):
        places: list[tuple[int, int]] = []  # (bit, byte)
        loops: list[tuple[int, bool]] = []  # (bit, also over '/')
        starts, accepts, bit = [], [], 0
        for glob in globs:
            raw, i = glob.encode(), 0
            starts.append(bit)
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    both = raw[i : i + 2] == b"**"
                    loops.append((bit, both))
                    i += 1 + both
                else:
                    bit += 1
                    places.append((bit, raw[i]))
                    i += 1
            accepts.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.step = np.zeros((256, self.words), _U)
        self.loop = np.zeros((256, self.words), _U)
        self.start = self._mask(starts)
        self.accept = self._mask(accepts)
        self.bits = np.array(accepts, np.int64)
        for b, c in places:
            self.step[c, b // 64] |= _U(1) << _U(b % 64)
        for b, both in loops:
            rows = np.arange(256) if both else np.flatnonzero(np.arange(256) != ord("/"))
            self.loop[rows, b // 64] |= _U(1) << _U(b % 64)
        self.settled = self.accept & self._mask([b for b, both in loops if both])  # set for good, and nothing follows

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, _U)
        for b in bits:
            out[b // 64] |= _U(1) << _U(b % 64)
        return out

    def _alone(self, state: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The state after the bytes of rest, for one long URL: the same step on one whole number for all words."""
        whole = lambda words: int.from_bytes(words.tobytes(), "little")
        step, loop, settled, now = [whole(x) for x in self.step], [whole(x) for x in self.loop], whole(self.settled), whole(state)
        for c in rest.tobytes():
            if not now & ~settled:
                break
            now = ((now << 1) & step[c]) | (now & loop[c])
        return np.frombuffer(now.to_bytes(8 * self.words, "little"), _U)

    def first(self, urls: list[bytes]) -> np.ndarray:
        """The index of the first glob that fits each URL as a whole; -1 where none does."""
        found = np.full(len(urls), -1, np.int64)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        lengths = np.array([len(urls[i]) for i in order], np.int64)
        raw = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        at = np.cumsum(lengths) - lengths
        state = np.tile(self.start, (len(urls), 1))
        live = np.arange(len(urls))  # longest first
        j = 0
        while len(live):
            if j % PACK == 0:  # leave out those that no byte can change any more
                live = live[(lengths[live] > j) & (state[live] & ~self.settled).any(axis=1)]
                if len(live) <= FEW:
                    for i in live:
                        state[i] = self._alone(state[i], raw[at[i] + j : at[i] + lengths[i]])
                    break
            longer = live[: int(np.searchsorted(-lengths[live], -j, side="left"))]
            now = state[longer]
            c = raw[at[longer] + j]
            moved = now << _U(1)
            moved[:, 1:] |= now[:, :-1] >> _U(63)
            state[longer] = (moved & self.step[c]) | (now & self.loop[c])
            j += 1
        state &= self.accept
        rows = np.flatnonzero(state.any(axis=1))
        word = (state[rows] != 0).argmax(axis=1)
        low = state[rows, word]
        bit = word * 64 + np.log2((low & (~low + _U(1))).astype(np.float64)).astype(np.int64)
        found[np.array(order, np.int64)[rows]] = np.searchsorted(self.bits, bit)
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, without query and fragment; both empty for null or a URL without '://'."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for c in "#?":
        rest = rest.partition(c)[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), slash + path


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Verdict of each row's URL: (id, host, path, rule, verdict).

    rules: (verdict, host, path). A rule fits its host and all subdomains where the path starts with the rule's; the
    longest host + path wins, then "block", then the order of the text. Without a rule: rule null, verdict `default`.
    A null URL, or one without '://', has an empty host and path, which only rules with an empty host and path fit.
    Rows are kept one for one, repeated and null ids too; other columns of any name aren't read.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:]))
    owner = [r for r in ranked for _ in globs_of(*r[1:])]
    verdicts = pa.array([*(r[0] for r in owner), default])
    names = pa.array([*(r[1] + r[2] for r in owner), None], pa.string())
    globs = [g for r in ranked for g in globs_of(*r[1:])]
    kind = pages.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobSet(globs)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hit = pa.array(automaton.first([(h + p).encode("utf-8", "surrogatepass") for h, p in parts]) % len(verdicts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), names.take(hit), verdicts.take(hit)],
                [id_col, "host", "path", "rule", "verdict"],
            )

    return pages.select(id_col, url_col).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
