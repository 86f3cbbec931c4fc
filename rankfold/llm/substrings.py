"""Substring deduplication by level-wise doubling.

Windows of words that repeat at one length alone are extended to (about) twice
that length: a window of 2n-o words is a candidate only if the windows of n
words at both its ends repeat. The first length is a filter with short keys;
candidates at the next are few, so they can carry the document id and a full
64-bit key. Levels go on up to the wanted length, or (``longest``) until no
candidates survive, which gives each text's longest repeated window.

Texts are dealt once into chunks by a hash of the id. At each level a chunk
sends every distinct window once, in blobs by key range, and gets one bit back
for each: so a window that a third of all texts share costs one entry for each
chunk, and no task holds more than a key range or a chunk. Sorted keys travel
as byte planes of their differences, which the shuffle's codec packs.

A word is removed if a window that covers it also starts in a document with a
smaller id; windows are judged on the input.

Defined cases: rows without an id keep all their words and take none from others; null, empty and blank texts
have no words; rows with one id are one document as to order (they remove
nothing from each other); a text of any length is handled whole; other columns
play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.text import buffers, materialize, prepare, rows_of, total_bytes, window_hashes, word_hashes, word_spans

#: Text bytes in a chunk, and windows in a key range, about: what one task step holds.
CHUNK_BYTES, RANGE_WINDOWS = 3 << 20, 1 << 20
#: Key bits of the first level, a filter only.
FILTER_BITS = 46


def planes(sorted_keys: np.ndarray) -> bytes:
    """Differences of ascending 64-bit keys, byte plane by byte plane."""
    step = np.diff(sorted_keys, prepend=np.uint64(0)) if len(sorted_keys) else sorted_keys
    return step.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(raw).view("<u8").ravel(), dtype=np.uint64)


def plain_planes(values: np.ndarray) -> bytes:
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def plain_unplaned(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Chunk:
    """Words of a chunk's texts, documents in ascending order of their ids."""

    def __init__(self, rows: pa.Table):
        self.rows = rows.sort_by("id")
        self.ids = self.rows.column("id").to_numpy()
        self.data, self.offsets = buffers(self.rows.column("text"))
        self.starts, self.ends, self.docs = word_spans(self.data, self.offsets)
        self.words = word_hashes(self.data, self.starts, self.ends)
        self.alive: tuple[int, np.ndarray] | None = None  # length, mask over first words

    def windows(self, length: int):
        """First words and keys of the windows of this length that are still candidates."""
        at, keys = window_hashes(self.words, self.docs, length)
        if self.alive:
            shorter, mask = self.alive
            keep = mask[at] & mask[at + length - shorter]
            at, keys = at[keep], keys[keep]
        return at, keys

    def keep(self, length: int, at: np.ndarray, repeated: np.ndarray):
        mask = np.zeros(len(self.words), bool)
        mask[at[repeated]] = True
        self.alive = (length, mask)


def _first_entries(chunk: Chunk, length: int):
    """Distinct short keys of all windows, and whether each occurs more than once in the chunk."""
    at, keys = chunk.windows(length)
    keys = keys >> np.uint64(64 - FILTER_BITS)
    order = np.sort(keys)
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    distinct = order[new]
    twice = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
    return at, keys, distinct, twice


def _entries(chunk: Chunk, length: int):
    """Distinct keys of the candidate windows, the smallest id that has each, and each window's key number."""
    at, keys = chunk.windows(length)
    distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return at, number, distinct, chunk.ids[chunk.docs[at[first]]] if len(first) else np.zeros(0, np.int64)


def _cuts(distinct: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where the key ranges begin in sorted keys of so many bits; ``ranges`` is a power of two."""
    number = distinct >> np.uint64(bits - (ranges.bit_length() - 1)) if ranges > 1 else np.zeros(len(distinct), np.uint64)
    return np.searchsorted(number, np.arange(ranges + 1, dtype=np.uint64))


def _bits(replies, level: int, cuts: np.ndarray) -> np.ndarray:
    """The replies to a level's entries, one bit for each; no reply is no."""
    out = np.zeros(cuts[-1], bool)
    for number, k, bits in replies:
        if level == k:
            n = cuts[number + 1] - cuts[number]
            out[cuts[number] : cuts[number + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out


def _replay(chunk: Chunk, lengths: list[int], replies, ranges: int):
    """Applies the replies of the levels done; returns the last level's windows,
    whether each repeats, and whether each also starts in a smaller document."""
    at, smaller, repeated = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    for level, length in enumerate(lengths):
        if level == 0:
            at, keys, distinct, twice = _first_entries(chunk, length)
            hit = _bits(replies, 0, _cuts(distinct, FILTER_BITS, ranges)) | twice
            repeated = hit[np.searchsorted(distinct, keys)] if len(distinct) else np.zeros(0, bool)
        else:
            at, number, distinct, owner = _entries(chunk, length)
            # two bits for each entry: another chunk has it; and a smaller document there
            found = _bits(replies, 2 * level, _cuts(distinct, 64, ranges))
            before = _bits(replies, 2 * level + 1, _cuts(distinct, 64, ranges))
            own = chunk.ids[chunk.docs[at]]
            smaller = before[number] | (own > owner[number]) if len(at) else smaller[:0]
            inside = np.zeros(len(distinct), bool)
            if len(at):
                inside[number[own > owner[number]]] = True
            repeated = (found | inside)[number] if len(at) else repeated[:0]
        chunk.keep(length, at, repeated)
    return at, repeated, smaller


def _send(lengths: list[int], ranges: int):
    """Entries of the next level of a chunk, in blobs by key range."""
    def made(rows: pa.Table, replies: pa.Table | None) -> pa.Table:
        out = {"range": [], "chunk": [], "keys": [], "more": []}
        if rows.num_rows:
            chunk = Chunk(rows)
            if len(lengths) == 1:
                _, _, keys, more = _first_entries(chunk, lengths[0])
                cuts = _cuts(keys, FILTER_BITS, ranges)
            else:
                _replay(chunk, lengths[:-1], _triples(replies), ranges)
                _, _, keys, more = _entries(chunk, lengths[-1])
                cuts = _cuts(keys, 64, ranges)
            for k in np.flatnonzero(np.diff(cuts)):
                lo, hi = cuts[k], cuts[k + 1]
                out["range"].append(int(k))
                out["chunk"].append(rows.column("chunk")[0].as_py())
                out["keys"].append(planes(keys[lo:hi]))
                out["more"].append(np.packbits(more[lo:hi]).tobytes() if len(lengths) == 1 else plain_planes(more[lo:hi]))
        return pa.table(out, schema=pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())]))

    if len(lengths) == 1:
        return lambda rows: made(rows, None)
    return lambda rows, replies: made(rows, replies)


def _triples(replies: pa.Table | None):
    if replies is None or not replies.num_rows:
        return []
    return [*zip(replies.column("range").to_pylist(), replies.column("level").to_pylist(), replies.column("bits").to_pylist(), strict=True)]


def _judge(level: int):
    """Within a key range: which entries other chunks have too, and which a smaller document has."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        keys = [unplaned(x) for x in rows.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        group = np.cumsum(new) - 1
        size = np.diff(np.append(np.flatnonzero(new), len(keys)))
        found = np.zeros(len(keys), bool)
        found[order] = size[group] > 1
        sets = [(level * 2 if level else 0, found)]
        if level:
            ids = np.concatenate([plain_unplaned(x) for x in rows.column("more").to_pylist()])
            least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
            before = np.zeros(len(keys), bool)
            before[order] = ids[order] > least[group]
            sets.append((level * 2 + 1, before))
        out = {"range": [], "chunk": [], "level": [], "bits": []}
        number = rows.column("range")[0].as_py()
        for k, c in enumerate(rows.column("chunk").to_pylist()):
            lo, hi = ends[k - 1] if k else 0, ends[k]
            for which, marks in sets:
                if marks[lo:hi].any():
                    out["range"].append(number)
                    out["chunk"].append(c)
                    out["level"].append(which)
                    out["bits"].append(np.packbits(marks[lo:hi]).tobytes())
        return pa.table(out, schema=pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("level", pa.int32()), ("bits", pa.binary())]))
    return run


_SENT = "range int, chunk long, keys binary, more binary"
_REPLY = "range int, chunk long, level int, bits binary"


def levels(length: int) -> list[int]:
    """A filter length of half the wanted length, rounded up, then that length."""
    return [max(1, (length + 1) // 2), length]


def _finish(lengths: list[int], target: int, ranges: int, longest: bool):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({c: [] for c in ("id", "n_words", "n_removed", "kept", "sha", "longest")}, schema=_OUT(rows))
        chunk, answers = Chunk(rows), _triples(replies)
        done = 2  # the filter and the wanted length
        at, _, smaller = _replay(chunk, lengths[:done], answers, ranges)
        cover = np.zeros(len(chunk.words) + 1, np.int64)
        np.add.at(cover, at[smaller], 1)
        np.add.at(cover, np.minimum(at[smaller] + target, len(chunk.words)), -1)
        removed = np.cumsum(cover[:-1]) > 0
        n = len(chunk.ids)
        run_length = np.zeros(n, np.int64)
        if longest:
            for k in range(done, len(lengths) + 1):
                fresh = Chunk(rows)
                at, repeated, _ = _replay(fresh, lengths[:k], answers, ranges)
                run_length[np.unique(chunk.docs[at[repeated]])] = lengths[k - 1]
        first = np.searchsorted(chunk.docs, np.arange(n + 1))
        gone = np.concatenate([[0], np.cumsum(removed)])[first]
        kept, sha = [], []
        raw = chunk.data.tobytes()
        for k in range(n):
            words = raw[chunk.offsets[k] : chunk.offsets[k + 1]].split()
            if gone[k + 1] > gone[k]:
                words = [words[j] for j in np.flatnonzero(~removed[first[k] : first[k + 1]])]
            line = b" ".join(words)
            sha.append(hashlib.sha256(line).hexdigest())
            kept.append(line.decode("utf-8", "replace"))
        return pa.table([chunk.rows.column("id"), pa.array(np.diff(first)), pa.array(np.diff(gone)), pa.array(kept, pa.string()),
                         pa.array(sha, pa.string()), pa.array(run_length)], schema=_OUT(rows))
    return run


def _OUT(rows: pa.Table) -> pa.Schema:
    return pa.schema([("id", rows.schema.field("id").type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                      ("sha", pa.string()), ("longest", pa.int64())])


def drop_repeats(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text: str = "text", longest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256, longest_repeat) for each row.
    ``kept``: the words that stay, joined by one space. ``longest``: go on
    doubling until no candidates survive; longest_repeat is then the largest
    length tried at which a window of the text is in another text as well."""
    spark = docs.sparkSession
    prepare(spark)
    total = total_bytes(docs, text)
    chunks = max(1, -(-total // CHUNK_BYTES))
    ranges = 1 << max(0, (total // (6 * RANGE_WINDOWS)).bit_length())
    rows = rows_of(docs, id_col, text).toDF("id", "text").where("id is not null").select(
        F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), F.col("id").cast("long").alias("id"), "text")
    dealt = rows.groupBy("chunk")
    lengths, replies = levels(words)[:1], None
    for length in (levels(words) if levels(words)[0] < words else [words, words]):
        if replies is None:
            sent = dealt.applyInArrow(_send([length], ranges), _SENT)
            lengths = [length]
        else:
            lengths.append(length)
            sent = dealt.cogroup(replies.groupBy("chunk")).applyInArrow(_send(lengths, ranges), _SENT)
        judged = sent.groupBy("range").applyInArrow(_judge(len(lengths) - 1), _REPLY)
        replies = judged if replies is None else replies.union(judged)
    while longest:
        replies = materialize(replies)
        if replies.where(F.col("level") == 2 * (len(lengths) - 1)).isEmpty():
            break
        lengths.append(2 * lengths[-1])
        sent = dealt.cogroup(replies.groupBy("chunk")).applyInArrow(_send(lengths, ranges), _SENT)
        replies = replies.union(sent.groupBy("range").applyInArrow(_judge(len(lengths) - 1), _REPLY))
    out = dealt.cogroup(replies.groupBy("chunk")).applyInArrow(
        _finish(lengths, words, ranges, longest), "id long, n_words long, n_removed long, kept string, sha string, longest long")
    kind = docs.schema[id_col].dataType
    out = out.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept", F.col("sha").alias("kept_sha256"),
                     F.col("longest").alias("longest_repeat"))
    # rows without an id have no place in the order: their words stay, and no other text loses words to them
    alone = rows_of(docs, id_col, text).toDF("id", "text").where("id is null").select(
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), 0).alias("words"))
    line = F.array_join("words", " ")
    return out.unionByName(alone.select(F.lit(None).cast(kind).alias(id_col), F.size("words").cast("long").alias("n_words"),
                                        F.lit(0).cast("long").alias("n_removed"), line.alias("kept"),
                                        F.sha2(line.cast("binary"), 256).alias("kept_sha256"), F.lit(0).cast("long").alias("longest_repeat")))
