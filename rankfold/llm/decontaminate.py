"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
windows of all benchmark items scans each text once; hits are mapped back to
offsets of the original text.

A text is normalised by lower-casing A-Z and taking the words (runs of a-z,
0-9 and all characters from U+0080). A window is ``words`` consecutive words of
an item; an item with fewer words, but not none, is one window.

The benchmark is a stated query set. Tasks cut it into blocks of about
BLOCK_BYTES of item text, written once to the shared folder; the driver holds
those of one partition at most (TASK_BLOCKS) and broadcasts one. Each block is
a pass over the documents, and a pass is written before the next begins, so
that a worker has one automaton of bounded size whatever the benchmark's size.
A benchmark of one block is one lazy pass that writes nothing.

Defined cases: a null or empty text has no words and no hits; an item row with
no id or no words has no windows; items with the same id are one item; a text
of any length is scanned whole; repeated document rows are scanned each;
columns other than the named ones play no part.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.llm.text import add_column, materialize, prepare, rows_of, total_bytes
from rankfold.session import remove_path, scratch_path

#: An automaton takes about 250 bytes of memory for each byte of item text.
BLOCK_BYTES = 512 << 10
#: Blocks that one task cuts, about.
TASK_BLOCKS = 16
#: Words of a run; runs of a long item overlap by a window less one word, so no window is lost.
RUN_WORDS = 4096

_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32
                for c in range(256))
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")

HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("words", T.ArrayType(T.ArrayType(T.LongType()))),
])
_PAIRS = pa.list_(pa.list_(pa.int64()))
_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                   ("spans", _PAIRS), ("words", _PAIRS)])


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


_BLOCK = pa.schema([("runs", pa.list_(pa.struct([("item", pa.string()), ("run", pa.string())])))])


def _cut(words: int, most: int):
    """Rows (id, text) to blocks of runs, one block a row."""
    def run(batches):
        block, size = [], 0
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = normal_words(text) if item is not None and text else []
                for lo in range(0, max(1, len(found) - words + 1) if found else 0, RUN_WORDS):
                    part = b" ".join(found[lo : lo + RUN_WORDS + words - 1])
                    block.append({"item": item, "run": part.decode()})
                    size += len(part)
                    if size >= most:
                        yield pa.RecordBatch.from_pylist([{"runs": block}], schema=_BLOCK)
                        block, size = [], 0
        if block:
            yield pa.RecordBatch.from_pylist([{"runs": block}], schema=_BLOCK)
    return run


def item_blocks(benchmark: DataFrame, item: str, text: str, words: int):
    """Blocks of (item id, run of item words), read one partition at a time."""
    tasks = max(1, -(-total_bytes(benchmark, text) // (BLOCK_BYTES * TASK_BLOCKS)))
    rows = rows_of(benchmark, item, text).toDF("item", "text").select(F.col("item").cast("string"), "text")
    blocks = materialize(rows.repartition(tasks).mapInArrow(_cut(words, BLOCK_BYTES), "runs array<struct<item string, run string>>"))
    for row in blocks.toLocalIterator():
        yield [tuple(x) for x in row.runs]


_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(block, words: int) -> ahocorasick.Automaton:
    """Windows, each between spaces, with the ids of the items that hold them; kept by worker."""
    key = hashlib.sha256(repr((words, block)).encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        windows: dict[str, set[str]] = {}
        for item, run in block:
            run = run.split(" ")
            for lo in range(max(1, len(run) - words + 1)):
                windows.setdefault(f" {' '.join(run[lo : lo + words])} ", set()).add(item)
        out = ahocorasick.Automaton()
        for window, items in windows.items():
            out.add_word(window, (window.count(" ") - 1, tuple(items)))
        out.make_automaton()
        _BUILT[key] = out
    return _BUILT[key]


def joined(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """The union of half-open ranges, as sorted disjoint ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def scan(text: str | None, found: ahocorasick.Automaton, before: dict | None = None) -> dict:
    """Hit words, hit spans (code points, end exclusive) and items of a text."""
    words = normal_words(text) if text else []
    items, ranges = set(before["items"] if before else ()), [tuple(x) for x in before["words"]] if before else []
    if words:
        line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        gaps = None
        for end, (length, ids) in found.iter(line):
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            last = int(np.searchsorted(gaps, end))  # the gap behind the last word has the number of words before it
            ranges.append((last - length, last))
            items.update(ids)
    ranges = joined(ranges)
    spans = []
    if ranges:
        at = [m.span() for m in _WORD.finditer(text)]
        spans = [[at[lo][0], at[hi - 1][1]] for lo, hi in ranges]
    return {"n_words": len(words), "n_hit": sum(hi - lo for lo, hi in ranges), "items": sorted(items),
            "spans": spans, "words": ranges}


def mark_contamination(docs: DataFrame, benchmark: DataFrame, words: int = 10, text: str = "text",
                       item: str = "item_id", item_text: str = "text", out: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, items (ids as
    sorted strings), spans (hit passages of the original text) and words (the
    same passages as word ranges). Documents are never shuffled: every pass is
    row by row. Of the passes' tables two exist at most."""
    spark = docs.sparkSession
    prepare(spark)
    written = shared = None
    for k, block in enumerate(item_blocks(benchmark, item, item_text, words)):
        if k:
            before, written = written, scratch_path(spark, "hits")
            docs = _written(docs, written)
            shared.unpersist()
            if before:
                remove_path(spark, before)
        shared = spark.sparkContext.broadcast(block)
        docs = add_column(docs, out, HITS, text, _pass(shared, words, text, out if k else None))
    return docs if shared else add_column(docs, out, HITS, text, _pass(None, words, text, None))


def _pass(shared, words: int, text: str, before: str | None):
    """Scans with one block's automaton, on top of the hits in column ``before``."""
    def make(batch):
        found = automaton(shared.value, words) if shared else None
        hits = batch.column(before).to_pylist() if before else [None] * batch.num_rows
        texts = batch.column(text).to_pylist()
        return pa.array([scan(t, found, b) if found else _words_only(t) for t, b in zip(texts, hits, strict=True)], _HITS)
    return make


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and reread; under plain names, so its own may be any."""
    df.toDF(*[f"c{k}" for k in range(len(df.columns))]).write.parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*df.columns)


def _words_only(text: str | None) -> dict:
    return {"n_words": len(normal_words(text)) if text else 0, "n_hit": 0, "items": [], "spans": [], "words": []}
