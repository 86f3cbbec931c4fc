"""Best-fit packing with certified bin counts.

1. Every text is tokenised once. Documents longer than a sequence are cut into
   pieces of its length; a full piece is a sequence of its own. Pieces go to a
   table in the shared folder with a row number, so what follows is settled
   even when tasks are run again.
2. Shorter pieces are dealt to blocks of a bounded mean size by a hash of the
   row number: copies, hot sources and rows without an id spread like others.
   A task packs its block by best-fit decreasing. Dual feasible functions map the
   lengths so that no sequence can hold more than 1 in all; the greatest rounded
   sum is a lower bound. A block that meets it is certified: no packing has fewer.
3. Blocks give up their emptiest sequences, as many as hold the free space of one
   sequence more than the gap to the bound. The documents in these are
   exchanged (dealt anew to fewer blocks) and packed again. A round counts only if it needs fewer sequences; it ends when the total
   meets the bound of all lengths, when one block held all, or without gain.
   Each round is written, so a lost executor costs tasks of one round.

Only lengths and row keys are shuffled, never ids.

Defined cases: a null or empty text is the end id alone; repeated rows and rows
without an id are packed each; an empty table gives no pieces; other columns
play no part.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.text import prepare, rows_of, slices
from rankfold.session import scratch_path

#: Pieces in a block, on average, and rounds of exchange at most (each must save a sequence).
BLOCK_PIECES, ROUNDS = 1 << 16, 12
#: Bins with at most 1 / NEARLY_FULL free stay.
NEARLY_FULL = 128
#: Dual feasible functions u(k) tried, and words in a worker's table of known ones.
FUNCTIONS, KNOWN_WORDS = 64, 1_000_000
END = 0

_LOADED: dict = {}
# characters that no normalisation changes but for case; \s holds none beyond those of ASCII here
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞]*+")
# marks other than those in the pattern below
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
# fixed value: the pre-tokenizer pattern of the word vocabulary, under which words never reach over white space
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _drops_spaces(spec: dict) -> bool:
    """Does the tokenizer lower-case, drop white space and treat what is between on its own?"""
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") is True \
        and split.get("pattern") == {"Regex": _WORDS}


class Encoder:
    """Texts -> their ids as little-endian 32-bit bytes, as the tokenizer file at
    ``path`` gives them. Where words between white space are coded each on its
    own, known words are looked up, and new ones coded many at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = _drops_spaces(json.load(f))
        self.barred = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _code(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of new words. Marks behind letters are coded apart: the tokenizer parts them too."""
        ends = {w: len(w.rstrip(_MARKS)) for w in words}
        ends = {w: n if 0 < n < len(w) and w[:n].isalpha() else len(w) for w, n in ends.items()}
        units = [*{u for w, n in ends.items() for u in (w[:n], w[n:]) if u and u not in self.known}]
        fresh = {}
        for lo in range(0, len(units), 1 << 14):
            some = units[lo : lo + (1 << 14)]
            ids = [c.ids for c in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            at = [0, *itertools.accumulate(4 * len(x) for x in ids)]
            blob = np.fromiter(itertools.chain.from_iterable(ids), "<u4", at[-1] // 4).tobytes()
            fresh.update((w, blob[x:z]) for w, x, z in zip(some, at, at[1:], strict=False))
        unit = lambda u: fresh[u] if u in fresh else self.known[u]
        fresh |= {w: unit(w[:n]) + unit(w[n:]) for w, n in ends.items() if n < len(w)}
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known.clear()
        self.known.update(fresh)
        return fresh

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 512):
            some = [t or "" for t in texts[lo : lo + 512]]
            plain = [self.by_word and _PLAIN.fullmatch(t) is not None and not any(b in t for b in self.barred) for t in some]
            words = [t.lower().split() if ok else None for t, ok in zip(some, plain, strict=True)]
            codes = [None if w is None else [*map(self.known.get, w)] for w in words]
            new = {x for w, c in zip(words, codes, strict=True) if c and None in c for x, y in zip(w, c, strict=True) if y is None}
            fresh = self._learn(new) if new else {}
            for t, w, c in zip(some, words, codes, strict=True):
                if w is None:
                    out.append(self._code(t))
                else:
                    out.append(b"".join([fresh[x] if y is None else y for x, y in zip(w, c, strict=True)] if None in c else c))
        return out


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


_PIECE = "id {0}, piece int, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _cut(path: str, length: int):
    def run(batches):
        encode, end = encoder(path), np.asarray([END], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for k, blob in enumerate(encode(part.column("text").to_pylist())):
                    blob += end
                    for start in range(0, len(blob) // 4, length):
                        rows.append((k, start // length, start, blob[4 * start : 4 * (start + length)], len(blob) // 4))
                row, piece, start, ids, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([zlib.crc32(b) for b in ids], pa.int64()),
                    pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["id", "piece", "start", "length", "ids_crc32", "doc_tokens", "ids"])
    return run


def piece_table(docs: DataFrame, path: str, length: int, id_col: str = "doc_id", text: str = "text") -> str:
    """Writes the pieces of all documents with their ids and a row number ``uid``; returns the path."""
    spark = docs.sparkSession
    prepare(spark)
    rows = rows_of(docs, id_col, text).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    pieces = rows.mapInArrow(_cut(path, length), _PIECE.format(kind)).withColumn("uid", F.monotonically_increasing_id())
    pieces.write.option("compression", "zstd").parquet(at := scratch_path(spark, "pieces"))
    return at


def lower_bound(count: np.ndarray, length: int) -> int:
    """Sequences of ``length`` that any packing needs, ``count[s]`` pieces of each
    length s up to it: the best of the dual feasible functions f(l) (lengths
    over length - l count as full, those below l as nothing) and u(k) after f(l)."""
    count = np.asarray(count, np.int64)
    size = np.arange(length + 1, dtype=np.int64)
    low = np.arange(0, length // 2 + 1)  # l = 0: the plain sum
    full = count.sum() - np.cumsum(count)[length - low]
    best = 0
    for k in range(FUNCTIONS + 1):
        if k == 0:
            worth, one = size, length
        else:  # u(k) in units of 1 / (k * length)
            up = (k + 1) * size
            worth, one = np.where(up % length == 0, size * k, up // length * length), k * length
        sums = np.concatenate([[0], np.cumsum(worth * count)])
        inside = sums[length - low + 1] - sums[low]
        best = max(best, int((-(-(full * one + inside) // one)).max()))
    return best


def best_fit(sizes: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece and the free space of each bin; each piece,
    in the order given, goes to the fullest bin that has room."""
    bins, offsets, free = [], [], []
    by_free: list[list[int]] = [[] for _ in range(length + 1)]
    some = 0  # bit s: there is a bin with s free
    for size in sizes:
        room = some >> size
        if room:
            left = size + (room & -room).bit_length() - 1
            b = by_free[left].pop()
            if not by_free[left]:
                some &= ~(1 << left)
        else:
            b, left = len(free), length
            free.append(length)
        bins.append(b)
        offsets.append(length - left)
        free[b] = left = left - size
        if left:
            by_free[left].append(b)
            some |= 1 << left
    return bins, offsets, free


def released(free: np.ndarray, gap: int, length: int) -> np.ndarray:
    """The bins that a block gives up (see above), emptiest first."""
    order = np.argsort(-free, kind="stable")
    order = order[free[order] > length // NEARLY_FULL]
    return order[: int(np.searchsorted(np.cumsum(free[order]), (gap + 1) * length)) + 1]


def _fit(length: int, turn: int):
    def run(rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows.column("uid").to_numpy(), -rows.column("length").to_numpy()))
        rows = rows.take(pa.array(order))
        sizes = rows.column("length").to_numpy()
        bins, offsets, free = best_fit(sizes.tolist(), length)
        bins, free = np.array(bins, np.int64), np.array(free, np.int64)
        bound = lower_bound(np.bincount(sizes, minlength=length + 1), length)
        open_ = np.zeros(len(free), bool)
        open_[released(free, len(free) - bound, length)] = True
        block = rows.column("block")[0].as_py()
        return rows.drop_columns(["block"]).append_column("sequence_id", pa.array((turn << 56) + (block << 24) + bins)).append_column(
            "offset", pa.array(offsets, pa.int64())).append_column("certified", pa.array(np.full(len(bins), len(free) == bound))).append_column(
            "open", pa.array(open_[bins]))
    return run


def bound_of(pieces: DataFrame, length: int) -> int:
    """The lower bound of all pieces; the driver reads one row per length."""
    count = np.zeros(length + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return lower_bound(count, length)


def pack(docs: DataFrame, path: str, length: int = 2048, id_col: str = "doc_id", text: str = "text", block_pieces: int | None = None,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and ``certified`` (its block met its lower bound).
    ``with_ids``: also its ids."""
    spark = docs.sparkSession
    block_pieces = block_pieces or BLOCK_PIECES
    at = piece_table(docs, path, length, id_col, text)
    pieces = spark.read.parquet(at).drop("ids")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long, certified boolean, open boolean"
    columns = [*pieces.columns, "sequence_id", "offset", "certified"]
    whole = pieces.where(F.col("length") == length).withColumns(
        {"sequence_id": -F.col("uid") - 1, "offset": F.lit(0).cast("long"), "certified": F.lit(True)})
    pool, n = pieces.where(F.col("length") < length), None
    bound = bound_of(pool, length)
    n, used, done, parts = pool.count(), None, 0, [whole.select(*columns)]
    last = None  # the round before: what it gave up is packed by the next, or stays
    for turn in range(1, ROUNDS + 1):
        blocks = -(-n // block_pieces)
        if not blocks:
            break
        dealt = pool.select(*pieces.columns, F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(blocks)).alias("block"))
        dealt.groupBy("block").applyInArrow(_fit(length, turn), kind).write.parquet(here := scratch_path(spark, "packed"))
        now = spark.read.parquet(here)
        sizes = now.groupBy("open").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence_id").alias("bins")).collect()  # two rows
        bins = {r["open"]: (r["n"], r["bins"]) for r in sizes}
        total = sum(b for _, b in bins.values())
        if used is not None and total >= used:
            break  # no gain: what the round before gave up stays as it was
        if last is not None:
            parts[-1] = last.where("not open").select(*columns)
        parts.append(now.select(*columns))
        last, done = now, done + bins.get(False, (0, 0))[1]
        n, used = bins.get(True, (0, 0))
        if blocks == 1 or used < 2 or done + used <= bound:
            break
        pool = now.where("open")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if with_ids:
        out = out.join(spark.read.parquet(at).select("uid", "ids"), "uid")
    return out.drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, of pieces with their ids; at most one sequence's pieces in a group."""
    sorted_ids = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(sorted_ids, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


__all__ = ["best_fit", "bound_of", "lower_bound", "pack", "piece_table", "released", "sequences"]
