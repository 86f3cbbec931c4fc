"""Mixture-controlled packing of documents into sequences of fixed length.

Deficit round-robin over source queues: each window adds a source's target
share of its tokens to the source's credit and takes pieces from queues with
credit in turn. What a source got too much or too little is its deficit, which
the next window starts with.

1. Every text is tokenised once; ids go to a table in the shared folder with a
   block number, a hash of the row and of its place in the input. Blocks have a bounded
   mean size: a source with a third of all rows, and one row repeated many
   times, are spread over all blocks. The table is written before anything
   reads block numbers, so tasks that run again do not move rows.
2. Deficits are carried across blocks by prefix sums of the blocks' token
   totals by source: a block packs all its tokens, so what it passes on is
   known from totals alone and blocks are packed side by side.
3. Each block is packed by one task: documents of a source in the order of a
   hash, cut only where a sequence is full. The last sequence of a block is the
   only one with padding.

Defined cases: a null or empty text is the end id alone; null sources are one
source; repeated rows are packed each; an empty table gives no pieces; other
columns play no part.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.text import prepare, rows_of, slices, total_bytes
from rankfold.session import scratch_path

#: Text bytes in a block, about; a block's ids are in one task's memory.
BLOCK_BYTES = 8 << 20
#: Blocks whose totals one window sums.
SPAN = 4096
END = 0

_LOADED: dict = {}
# the rank file's engine agrees with the tokenizer for these characters; others go to the tokenizer itself
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*+")


def encoder(path: str, ranks: str | None):
    """texts -> arrays of ids, as the tokenizer file at ``path`` gives them. With a
    rank file of the same vocabulary, texts of plain characters take that
    faster engine; both give the same ids."""
    if (path, ranks) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        slow, fast = Tokenizer.from_file(path), None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
            barred = [*special]
        else:
            barred = []

        def encode(texts: list[str]) -> list[np.ndarray]:
            out = []
            for t in texts:
                if not t:
                    out.append(np.zeros(0, np.uint32))
                elif fast is not None and _PLAIN.fullmatch(t) and not any(b in t for b in barred):
                    out.append(np.asarray(fast.encode_ordinary(t), np.uint32))
                else:
                    out.append(np.asarray(slow.encode(t, add_special_tokens=False).ids, np.uint32))
            return out

        _LOADED[path, ranks] = encode
    return _LOADED[path, ranks]


def _tokenise(path: str, ranks: str | None):
    def run(batches):
        encode = encoder(path, ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.append(x, np.uint32(END)) for x in encode(part.column("text").to_pylist())]
                blobs = [x.astype("<u4").tobytes() if x.max() > 0xFFFF else x.astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("source"), part.column("block"), part.column("turn"),
                    pa.array([len(x) for x in ids], pa.int64()), pa.array(blobs, pa.binary())],
                    names=["id", "source", "block", "turn", "n", "ids"])
    return run


def token_table(docs: DataFrame, path: str, ranks: str | None, id_col: str, text: str, source: str) -> str:
    """Writes (id, source, block, turn, n, ids) to the shared folder and returns its path."""
    spark = docs.sparkSession
    blocks = max(1, -(-total_bytes(docs, text) // BLOCK_BYTES))
    rows = rows_of(docs, id_col, text, source).toDF("id", "text", "source").select(
        "id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.xxhash64("id", "source", F.octet_length("text")).alias("turn"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("turn", F.monotonically_increasing_id()), F.lit(blocks)))
    kind = rows.schema["id"].dataType.simpleString()
    at = scratch_path(spark, "tokens")
    rows.select("id", "text", "source", "block", "turn").mapInArrow(
        _tokenise(path, ranks), f"id {kind}, source string, block long, turn long, n long, ids binary",
    ).write.option("compression", "zstd").parquet(at)
    return at


def deal(queues: dict[str, list[tuple[int, int]]], share: dict[str, float], credit: dict[str, float], length: int):
    """Yields (document, start, length, sequence, offset): deficit round-robin
    over ``queues`` (source -> [(document, tokens)]), in sequences of ``length``."""
    names, at = sorted(queues), dict.fromkeys(queues, 0)
    used = dict.fromkeys(queues, 0)  # ids taken of the head document
    credit = {s: credit.get(s, 0.0) for s in names}
    sequence, k = 0, 0
    names = [s for s in names if queues[s]]
    while names:
        for s in names:
            credit[s] += share.get(s, 0.0) * length
        room = length
        while room and names:
            for step in range(len(names)):  # the next queue in turn that has credit, else the one with most
                s = names[(k + step) % len(names)]
                if credit[s] > 0:
                    k = (k + step) % len(names)
                    break
            else:
                s = max(names, key=lambda x: credit[x])
                k = names.index(s)
            doc, n = queues[s][at[s]]
            took = min(n - used[s], room)
            yield doc, used[s], took, sequence, length - room
            room -= took
            credit[s] -= took
            used[s] += took
            if used[s] == n:
                at[s], used[s] = at[s] + 1, 0
                if at[s] == len(queues[s]):
                    names.pop(k)
                    k = k % len(names) if names else 0
                    continue
            if credit[s] <= 0:
                k = (k + 1) % len(names)
        sequence += 1


def _pack(length: int):
    def run(rows: pa.Table, credits: pa.Table) -> pa.Table:
        order = np.lexsort((np.arange(rows.num_rows), rows.column("turn").to_numpy()))
        rows = rows.take(pa.array(order))
        sources, sizes = rows.column("source").to_pylist(), rows.column("n").to_pylist()
        queues: dict[str, list[tuple[int, int]]] = {}
        for k, (s, n) in enumerate(zip(sources, sizes, strict=True)):
            queues.setdefault(s, []).append((k, n))
        known = credits.to_pylist()
        pieces = [*deal(queues, {r["source"]: r["share"] for r in known}, {r["source"]: r["deficit"] for r in known}, length)]
        blobs = rows.column("ids").combine_chunks() if rows.num_rows else []
        crcs = []
        for doc, start, n, _, _ in pieces:
            blob = blobs[doc].as_buffer()
            ids = np.frombuffer(blob, "<u2" if blob.size == 2 * sizes[doc] else "<u4")[start : start + n]
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        doc, start, n, sequence, offset = np.array(pieces, np.int64).reshape(-1, 5).T
        block = rows.column("block")[0].as_py() if rows.num_rows else 0
        return pa.table({
            "id": rows.column("id").take(pa.array(doc)), "source": rows.column("source").take(pa.array(doc)),
            "start": start.copy(), "length": n.copy(), "ids_crc32": np.array(crcs, np.int64),
            "doc_tokens": rows.column("n").take(pa.array(doc)), "sequence_id": sequence + (block << 32), "offset": offset.copy()})
    return run


def _before(totals: DataFrame, out: str, *keys: str) -> DataFrame:
    """``totals`` (block, n, keys) with the sum of n over all smaller blocks of
    the same keys, in two levels: no window holds more than a run of SPAN
    blocks, or the runs' sums."""
    rows = totals.withColumn("run", F.floor(F.col("block") / SPAN))
    below = lambda w: F.coalesce(w, F.lit(0))
    runs = rows.groupBy(*keys, "run").agg(F.sum("n").alias("n"))
    over_runs = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "run", below(F.sum("n").over(over_runs)).alias("head"))
    inside = Window.partitionBy(*keys, "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", below(F.sum("n").over(inside))).join(runs, [*keys, "run"])
    return rows.select(*totals.columns, (F.col("head") + F.col("part")).alias(out))


def pack(docs: DataFrame, path: str, ranks: str | None = None, length: int = 1024, weights: dict[str, float] | None = None,
         id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece. ``weights``: target proportions of the sources, by
    default their proportions of all tokens; sources without a weight come
    where the others have no credit or no documents left."""
    spark = docs.sparkSession
    prepare(spark)
    at = token_table(docs, path, ranks, id_col, text, source)
    tokens = spark.read.parquet(at)
    totals = spark.read.parquet(at).groupBy("block", "source").agg(F.sum("n").alias("n"))  # blocks x sources at most
    by_source = totals.groupBy("source").agg(F.sum("n").alias("of"))
    if weights is None:
        everything = by_source.agg(F.sum("of").alias("all")).first()["all"]  # one number
        share = F.col("of") / F.lit(float(everything or 1))
    else:
        whole = sum(weights.values())
        share = F.coalesce(*[F.when(F.col("source") == s, F.lit(w / whole)) for s, w in weights.items()], F.lit(0.0))
    shares = by_source.select("source", share.alias("share"))
    per_block = _before(totals.groupBy("block").agg(F.sum("n").alias("n")), "all_before").drop("n")
    credits = _before(totals, "before", "source").join(per_block, "block").join(shares, "source").select(
        "block", "source", "share", (F.col("share") * F.col("all_before") - F.col("before")).alias("deficit"))
    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.groupBy("block").cogroup(credits.groupBy("block")).applyInArrow(
        _pack(length), f"id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
