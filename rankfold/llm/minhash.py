"""Near-duplicate documents by min-max hashing and banding, links confirmed on full sets.

Under each of ``k`` permutations a document keeps the smallest and the largest
hash of its word shingles, so 2k signature values cost k hash evaluations for
each shingle. Bands of ``rows`` values are the bucket keys; the number of bands
follows from the threshold and the wanted miss probability of a single link.

1. Equal shingle sets become one node (a partial aggregate by the set's digest,
   so thousands of copies cost one row per task).
2. In each bucket every node is compared with the bucket's smallest node only;
   confirmed links give components.
3. Buckets that still hold several components are compared in blocks of at most
   BLOCK nodes: a task counts the common shingles of two blocks as a matrix
   product and gives back only the links that join components. So no pair of
   different sets that shares a bucket loses its link, and no group becomes
   rows of pairs.

Defined cases: rows without an id are counted and linked with nothing (no component); null, empty and blank texts
have no shingles, link with nothing and are kept; a text with fewer words than
a shingle is one shingle; every row gives a row, also where rows repeat; rows
that share an id but not a text are one node, compared by one of the texts (the
one with the smallest digest); other columns play no part; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.components import components
from rankfold.llm.text import SPACED, buffers, materialize, mix, prepare, rows_of, slices, window_hashes, word_hashes, word_spans

MISS = 1e-6
#: Nodes of a block, and shingles that one task step compares, about.
BLOCK, GROUP_SHINGLES = 256, 1 << 20


def band_chance(percent: int, rows: int) -> float:
    """The least probability that a band of two sets linked at ``percent`` is
    equal, over all sizes. A permutation's minimum and maximum are drawn without
    replacement, so with i common of u shingles both agree with probability
    i(i-1) / (u(u-1)), which is under (i/u)^2 and least for small sets."""
    pairs, odd = divmod(rows, 2)
    least = 1.0
    for u in range(2, 401):  # with i >= percent * u / 100 the lower envelope grows with u, so larger sets have no less
        i = -(-percent * u // 100)
        least = min(least, (i * (i - 1) / (u * (u - 1))) ** pairs * (i / u) ** odd)
    return least


def band_count(percent: int, rows: int, miss: float = MISS) -> int:
    """Bands for which a link of any size is missed with at most probability ``miss``."""
    chance = band_chance(percent, rows)
    if chance <= 0:
        raise ValueError(f"at {percent} percent sets of two or three shingles may share no band; take rows=1")
    return 1 if chance >= 1 else math.ceil(math.log(miss) / math.log1p(-chance))


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows in one array, and row offsets.
    Words are lower-cased in A-Z."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    starts, ends, docs = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, SPACED, fold=True)
    at, hashed = window_hashes(words, docs, size)
    owner = docs[at]
    counts = np.bincount(docs, minlength=n)
    first = np.cumsum(counts) - counts
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        _, whole = window_hashes(words[first[row] : first[row] + counts[row]], np.zeros(counts[row], np.int64), int(counts[row]))
        owner, hashed = np.append(owner, row), np.append(hashed, whole)
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    if len(hashed):
        new = np.ones(len(hashed), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
        owner, hashed = owner[new], hashed[new]
    return hashed, np.searchsorted(owner, np.arange(n + 1))


def signatures(hashed: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys [row, band] from min-max signatures; rows without shingles get zeros."""
    each = -(-rows // 2)  # permutations of a band: no two bands share one
    k = bands * each
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    full = np.flatnonzero(np.diff(offsets) > 0)
    values = np.zeros((2 * k, len(offsets) - 1), np.uint64)
    lo = 0
    while lo < len(full):  # as many rows as fit the cache
        hi = max(lo + 1, int(np.searchsorted(offsets[full], offsets[full[lo]] + 32768)))
        part = hashed[offsets[full[lo]] : offsets[full[hi - 1] + 1]]
        cuts = offsets[full[lo:hi]] - offsets[full[lo]]
        for j in range(k):
            x = (part ^ seeds[2 * j]) * (seeds[2 * j + 1] | np.uint64(1))
            x ^= x >> np.uint64(32)
            values[2 * j, full[lo:hi]] = np.minimum.reduceat(x, cuts)
            values[2 * j + 1, full[lo:hi]] = np.maximum.reduceat(x, cuts)
        lo = hi
    keys = np.zeros((len(offsets) - 1, bands), np.uint64)
    for b in range(bands):
        key = np.full(len(offsets) - 1, b + 1, np.uint64)
        for j in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[2 * b * each + j])
        keys[:, b] = key
    return keys


def _digests(hashed: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(hashed[a:b].tobytes(), digest_size=16).digest()
            for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _features(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, offsets = shingle_sets(part.column("text"), size)
                keys = signatures(hashed, offsets, bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(_digests(hashed, offsets), pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel())),
                ], names=["id", "n", "digest", "bands"])
    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, offsets = shingle_sets(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(_digests(hashed, offsets), pa.binary()),
                    pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(hashed.view(np.int64)))],
                    names=["id", "digest", "items"])
    return run


def _tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, total) of each pair, counted on the full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    inter = F.size(F.array_intersect("x", "y"))
    return materialize(both.select("a", "b", inter.alias("inter"), (F.size("x") + F.size("y") - inter).alias("total")))


def common_counts(items: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left sets with right sets: a product of
    incidence matrices, some columns at a time. Shingles of one set only have no column."""
    owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
    distinct, column, uses = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = uses > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width, out = 4096, np.zeros((len(left), len(right)))
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((len(items), width), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out


def _compare(percent: int):
    """Links across components within each pair of blocks; of several links
    between the same components, one."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("id", "ascending")])
        key, i, j, block, ids, comp = (rows.column(c).to_numpy() for c in ("key", "i", "j", "block", "id", "comp"))
        items = rows.column("items").combine_chunks()
        offsets, values = items.offsets.to_numpy(), items.values.to_numpy()
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(key) else []
        found = []
        for lo, hi in zip(new, [*new[1:], len(key)], strict=True):
            left, right = np.flatnonzero(block[lo:hi] == i[lo]), np.flatnonzero(block[lo:hi] == j[lo])
            if not len(left) or not len(right):
                continue
            size = (offsets[lo + 1 : hi + 1] - offsets[lo:hi]).astype(float)
            both = common_counts([values[offsets[k] : offsets[k + 1]] for k in range(lo, hi)], left, right)
            near = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
            near &= comp[lo:hi][left][:, None] != comp[lo:hi][right][None, :]
            above: dict = {}

            def top(x, above=above):
                while x in above:
                    x = above[x]
                return x
            for x, y in zip(*np.nonzero(near), strict=True):
                x, y = lo + left[x], lo + right[y]
                a, b = top(comp[x]), top(comp[y])
                if a != b:
                    above[max(a, b)] = min(a, b)
                    found.append((ids[x], ids[y]))
        kind = rows.schema.field("id").type
        return pa.table({"a": pa.array([f[0] for f in found], kind), "b": pa.array([f[1] for f in found], kind)})
    return run


def _block_links(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components that meet in a bucket."""
    now = members.select("key", "id", "n").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "comp", F.coalesce("comp", "id"))
    two = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"s{k}") for k in (1, 2)]
    several = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m"), *two).where(
        "c0 <> c1")
    several = several.groupBy("m", "s1", "s2").agg(F.min("key").alias("key"))  # the same members under several bands: once
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = materialize(now.join(several.select("key", "m"), "key").select(
        "key", "id", "n", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")))
    groups = max(1, (rows.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) // GROUP_SHINGLES)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "id", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))
    kind = members.schema["id"].dataType.simpleString()
    return rows.join(sets, "id").groupBy("grp").applyInArrow(_compare(percent), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, rows: int = 6, id_col: str = "doc_id",
                    text: str = "text", miss: float = MISS) -> DataFrame:
    """(id, n_shingles, component_id) for each row: the smallest id reachable
    over links with 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    prepare(spark)
    bands = band_count(percent, rows, miss)
    rows_in = rows_of(docs, id_col, text).toDF("id", "text").where("id is not null")
    id_type = rows_in.schema["id"].dataType.simpleString()
    features = materialize(rows_in.mapInArrow(
        _features(size, bands, rows), f"id {id_type}, n long, digest binary, bands array<long>"))
    nodes = features.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    keyed = nodes.select("id", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("top")).where("lead <> top").drop("top")
    members = materialize(keyed.join(shared, "key"))  # only buckets with several nodes
    wanted = members.select("id").distinct()
    sets = materialize(rows_in.join(wanted, "id", "left_semi").mapInArrow(
        _sets(size), f"id {id_type}, digest binary, items array<long>").groupBy("id").agg(
        F.min_by("items", "digest").alias("items")))
    linked = F.expr(f"100 * inter >= {int(percent)} * total")
    size_ok = F.expr(f"100 * least(n, other_n) >= {int(percent)} * greatest(n, other_n)")

    sizes = members.select(F.col("id").alias("lead"), F.col("n").alias("other_n")).distinct()
    first = members.where("id <> lead").select("id", "n", "lead").distinct().join(sizes, "lead").where(size_ok)
    tested = _tested(first.select(F.col("lead").alias("a"), F.col("id").alias("b")), sets)
    comps = components(tested.where(linked))

    links = tested.where(linked).select("a", "b")
    more = materialize(_block_links(members, comps, sets, percent))
    if not more.isEmpty():
        comps = components(links.union(more))
    per_set = nodes.select("digest", F.col("id").alias("node")).join(comps, "node", "left").select(
        "digest", F.coalesce("comp", "node").alias("comp"))
    out = features.select("id", "n", "digest").join(per_set, "digest", "left")
    lone = F.col("n") == 0
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                     F.when(lone, F.col("id")).otherwise(F.col("comp")).alias("component_id"))
    # rows without an id: counted, linked with nothing
    alone = rows_of(docs, id_col, text).toDF("id", "text").where("id is null").mapInArrow(
        _features(size, bands, rows), f"id {id_type}, n long, digest binary, bands array<long>")
    return out.unionByName(alone.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
