"""Vectorised word and window hashing over Arrow text columns, and small Spark helpers.

All functions work on whole Arrow batches: the UTF-8 bytes of a column are one
numpy buffer, words are byte ranges of it. Word bytes are told from separators
by a 256-entry table, which is exact for UTF-8 because every separator in use
is ASCII and never a part of a longer character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.session import materialize, ship_package

#: Bytes of text that one vectorised step handles; bounds a worker's memory.
SLICE_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def table(separators: bytes) -> np.ndarray:
    """True for each byte that belongs to a word."""
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Words `[^\x20\x09-\x0D]+`.
SPACED = table(b" \t\n\x0b\x0c\r")


def prepare(spark) -> None:
    """Ships the package to the workers and bounds the Arrow batches: documents
    are long, so a batch is limited by bytes as well as by rows."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def rows_of(df: DataFrame, *cols: str) -> DataFrame:
    """Only these columns; other columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES):
    """Parts of a batch with at most ``most`` bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def add_column(df: DataFrame, name: str, kind: T.DataType, text: str, make) -> DataFrame:
    """``df`` with column ``name`` made by ``make(batch) -> pa.Array`` from
    slices of Arrow batches. Rows and the other columns pass through; a column
    that already has this name is replaced. Columns go in under plain names, so
    theirs may hold dots."""
    fields = [f for f in df.schema.fields if f.name != name]
    keep, names = [f.name for f in fields], df.columns

    def run(batches):
        for b in batches:
            for part in slices(b.rename_columns(names), text):
                made = make(part)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [made], names=[*keep, name])

    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    return plain.mapInArrow(run, T.StructType([*fields, T.StructField(name, kind)]))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACED):
    """Byte starts and ends of all words, and the row each belongs to."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside[1:-1] & (~inside[:-2] | edge[:-1])
    last = inside[1:-1] & (~inside[2:] | edge[1:])
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @staticmethod
    def _grow(have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        return have

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._grow(self.up, self.base, n)
            self.down = self._grow(self.down, self.inverse, n)
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE), _Powers(0xD6E8FEB86659FD93 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(fold: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold:
        out[65:91] = out[97:123]
    return out


_VALUES = {False: _byte_values(False), True: _byte_values(True)}


def word_hashes(data, starts, ends, is_word: np.ndarray = SPACED, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (``fold``: A-Z as a-z)."""
    out = np.empty(len(starts), np.uint64)
    values = np.where(is_word, _VALUES[fold], np.uint64(0))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 20))))
        at = starts[lo]
        n = int(ends[hi - 1] - at)
        up, down = _BYTES.to(n)
        sums = np.add.reduceat(values[data[at : at + n]] * up[:n], starts[lo:hi] - at)
        out[lo:hi] = sums * down[starts[lo:hi] - at]
        lo = hi
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(_BASE)))


def window_hashes(words: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every run of ``length`` words of one row: its first word's index and its hash."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _WORDS.to(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    hashed = (total[length:] - total[:n]) * down[:n]
    whole = np.flatnonzero(docs[:n] == docs[length - 1 :])
    return whole, mix(hashed[whole] + np.uint64(length))


def total_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of text in all rows; sizes partitions, never results."""
    return int(docs.select(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0)


def first_by_hash(df: DataFrame, turn: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest values of the 64-bit hash column
    ``turn`` (ties by the other columns): a sample of bounded size. Rows beyond
    three times their expected share are put aside before the merge, so tasks
    send a few rows each however many tasks there are; if hashes are so uneven
    that too few stay, all rows are merged."""
    rest = [turn, *[c for c in df.columns if c != turn]]
    n = df.count()
    if n > 3 * most:
        part = df.where(F.col(turn) < int(-(1 << 63) + (1 << 64) * (3 * most / n)))
        if part.count() >= most:
            df = part
    return df.orderBy(*rest).limit(most)


__all__ = ["SPACED", "add_column", "buffers", "first_by_hash", "free_name", "materialize", "mix", "prepare", "rows_of", "slices", "table",
           "total_bytes", "window_hashes", "word_hashes", "word_spans"]
