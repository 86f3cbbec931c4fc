"""Periodic runs: stretches of words that repeat with a period.

Online sparse diagonal DP. A document is read word by word. Each earlier
occurrence of the word lies on a diagonal, its lag; the match length of a
diagonal whose lag matched the word before grows by one, and a diagonal that
does not go on ends there: with enough matches it is a run, given out at once.
Only diagonals that can still become a run are active:

* A run of period q has at least q matches, and with a least length of ``least``
  at least ceil(least / 2). So an occurrence opens a diagonal of lag q only if
  the words ahead agree that far. Lags are classed by powers of two; the class
  holds the earlier occurrences whose lag is in it, told apart by the words
  ahead (numbers of equal windows, by doubling, so exact) and by the word before:
  with the same word before, the diagonal is open already.
* A multiple of an open lag whose stretch starts at the same word has the same
  stretch (inside it, words a multiple of the period apart are equal), so it
  opens nothing: the smallest period alone is followed. "a a a a ..." has one
  open diagonal, not one for each pair of words.

What is active for one document is in proportion to its words, and the work
to n log n where repeats are periodic; a document is one task's, documents are
spread by Spark. There is no shuffle.

Defined cases: a null, empty or blank text has no words and no runs; repeated
rows and ties are judged row by row; an empty table gives an empty one; other
columns pass through, one named like the result is replaced.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankfold.llm.text import add_column, buffers, mix, prepare, window_hashes, word_hashes, word_spans

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                      T.StructField("collapsed", T.StringType())])
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _windows(ids: np.ndarray, have: int, want: int) -> np.ndarray:
    """Numbers of the windows of ``want`` words, equal for equal windows, from those of ``have``."""
    while have < want:
        to = min(want, 2 * have)
        pairs = ids[: len(ids) - (to - have)] * np.int64(len(ids) + 1) + ids[to - have :]
        ids, have = np.unique(pairs, return_inverse=True)[1].astype(np.int64), to
    return ids


class _Lags:
    """Earlier words with a lag in [lo, hi), by the window that starts there and the word before."""

    def __init__(self, lo: int, hi: int, windows: np.ndarray, repeated: np.ndarray, words: list[int]):
        self.lo, self.hi, self.words = lo, hi, words
        self.window = np.where(repeated, windows, -1).tolist()
        self.held: dict[int, dict[int, deque]] = {}

    def move(self, i: int) -> None:
        """The word at lag ``lo`` of word ``i`` comes in, the one at lag ``hi`` goes."""
        j = i - self.lo
        if 0 <= j < len(self.window) and (key := self.window[j]) >= 0:
            self.held.setdefault(key, {}).setdefault(self.words[j - 1] if j else -1, deque()).append(j)
        j = i - self.hi
        if 0 <= j < len(self.window) and (key := self.window[j]) >= 0:
            before = self.words[j - 1] if j else -1
            same = self.held[key][before]
            same.popleft()
            if not same:
                del self.held[key][before]

    def opened(self, i: int):
        """Earlier words from which a diagonal starts at word ``i``."""
        if i < len(self.window) and (key := self.window[i]) >= 0:
            before = self.words[i - 1] if i else -1
            for other, at in self.held.get(key, {}).items():
                if other != before or i == 0:
                    yield from at


def _classes(words: list[int], least: int) -> list[_Lags]:
    n, size, lo = len(words), -(-least // 2), 1
    ids, have, out = np.asarray(words, np.int64), 1, []
    while lo + size <= n:
        ids, have = _windows(ids, have, size), size
        repeated = np.bincount(ids)[ids] > 1
        if not repeated.any():
            break
        out.append(_Lags(lo, 2 * size, ids, repeated, words))
        lo = size = 2 * size
    return out


def runs_of(words: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and two
    periods, by start and period. ``words``: numbers, equal for equal words."""
    classes = _classes(words, least)
    if not classes:
        return []
    open_at: dict[int, int] = {}  # lag -> first word matched
    stretch: dict[int, list[int]] = {}  # first word of a stretch -> its open lags
    out = []

    def close(lag: int, end: int) -> None:
        first = open_at.pop(lag)
        start, matches = first - lag, end - first
        stretch[start].remove(lag)
        if not stretch[start]:
            del stretch[start]
        if matches >= lag and matches + lag >= least:
            out.append((start, matches + lag, lag))

    for i, word in enumerate(words):
        if open_at:
            for lag in [q for q in open_at if words[i - q] != word]:
                close(lag, i)
        for c in classes:
            c.move(i)
            for j in c.opened(i):
                lag = i - j
                if not any(lag % q == 0 for q in stretch.get(j, ())):
                    open_at[lag] = i
                    stretch.setdefault(j, []).append(lag)
    for lag in [*open_at]:
        close(lag, len(words))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs) -> list[bytes]:
    """Without the words that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def _may_repeat(hashes: np.ndarray, docs: np.ndarray, size: int) -> set[int]:
    """Rows in which some window of ``size`` words comes twice (by hash: a few others too)."""
    at, found = window_hashes(hashes, docs, size)
    rows = docs[at]
    keys = mix(found ^ mix(rows.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    twice = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return set(rows[order[twice]].tolist())


def _make(id_col: str, text: str, least: int, order):
    def make(part: pa.RecordBatch) -> pa.Array:
        data, offsets = buffers(part.column(text))
        starts, ends, docs = word_spans(data, offsets)
        first = np.searchsorted(docs, np.arange(part.num_rows + 1))
        orders = {}
        read = np.arange(len(starts))
        if order:
            for row, key in enumerate(part.column(id_col).to_pylist()):
                n = int(first[row + 1] - first[row])
                if n and (own := order(key, n)) is not None:
                    orders[row] = own
                    read[first[row] : first[row + 1]] = first[row] + own
        may = _may_repeat(word_hashes(data, starts, ends)[read], docs, -(-least // 2))
        raw, out = data.tobytes(), []
        for row in range(part.num_rows):
            words = raw[offsets[row] : offsets[row + 1]].split()
            if row in orders:
                words = [words[k] for k in orders[row].tolist()]
            runs = []
            if row in may:
                number: dict[bytes, int] = {}
                runs = runs_of([number.setdefault(w, len(number)) for w in words], least)
            out.append({"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs],
                        "collapsed": b" ".join(kept_words(words, runs)).decode()})
        return pa.array(out, _FOUND)
    return make


def mark_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text: str = "text", out: str = "repeats", order=None) -> DataFrame:
    """``docs`` with struct ``out``: ``n_words``, ``runs`` (start, length, period)
    and ``collapsed``, the words that no run holds after its first period,
    joined by one space. ``order(id, n)`` may give another order in which the
    n words of a document are read (None: as they stand)."""
    prepare(docs.sparkSession)
    return add_column(docs, out, FOUND, text, _make(id_col, text, least, order))


__all__ = ["kept_words", "mark_runs", "runs_of"]
