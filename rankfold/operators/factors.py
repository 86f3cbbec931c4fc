"""Latent factors: normalisation, blocked dot-product scoring, SVD (C-8..C-10, R-2).

Dot-product scoring is users x items by nature. It never emits that full
product: items lie in blocks by norm, users in slices, a task multiplies one
slice of each, masks what is seen and keeps a user's best k; users skip the
blocks whose bound is below their k-th best product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.operators.ranking import global_rank
from rankfold.session import batch_bytes, materialize, remove_path, scratch_path, ship_package, shuffles_removed, stored

U, I = "user_id", "item_id"
GROWTH = 8            # blocks up to a round's end, times those before it
MAX_BLOCKS = 1 << 20  # blocks of items by norm
SLACK = 1 + 1e-9      # over the rounding of a product and two norms
LEAST = np.finfo(np.float64).min
TINY = 1e-140         # norms up to it have squares that underflow
ROWS = 256            # users of a slice that meet a pack at once
#: Vectors, and bytes of vectors, in a packed row; bytes of packs that a task meets; bytes of an Arrow batch.
PACK, PACK_BYTES, PART_BYTES, BATCH_BYTES = 4096, 4 << 20, 64 << 20, 8 << 20


def l2_normalize(df: DataFrame, col: str = "factor") -> DataFrame:
    """C-9: divide each vector by its L2 norm; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(col, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn(col, F.when(norm > 0, F.transform(col, lambda x: x / norm)).otherwise(F.col(col)))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _packed(columns: list, key: str):
    """Rows sorted by ``key`` as one row each: its lists by column, vectors as one block of numbers."""
    def run(batches):
        held = []

        def row():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for f, x in zip(columns[0], columns[1](t), strict=True)], schema=columns[0])

        for batch in batches:
            at = batch.column(key).to_numpy()
            for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
                if len(cut):
                    if held and held[0].column(key)[0].as_py() != at[cut[0]]:
                        yield row()
                    held.append(batch.slice(cut[0], len(cut)))
        if held:
            yield row()
    return run


_ITEMS = pa.schema([("_pack", pa.int32()), ("_first", pa.int32()), ("_ids", pa.list_(pa.string())), ("_iv", pa.binary())])
_USERS = pa.schema([("_s", pa.int32()), ("_users", pa.list_(pa.string())), ("_hi", pa.list_(pa.int32())), ("_uv", pa.binary()),
                    ("_row", pa.list_(pa.int32())), ("_at", pa.list_(pa.int32())), ("_item", pa.list_(pa.string()))])


def _numbers(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def _item_row(t: pa.Table) -> list:
    return [t.column("_pack")[0].as_py(), pc.min(t.column("_b")).as_py(), t.column(I).to_pylist(), _numbers(t.column("factor")).tobytes()]


def _user_row(t: pa.Table) -> list:
    """Users with their vectors, and the seen pairs by pack, as rows of those users."""
    known = pc.is_valid(t.column("factor"))
    users, seen = t.filter(known), t.filter(pc.invert(known))
    ids = users.column(U).to_pandas()
    pairs = pd.DataFrame({U: seen.column(U).to_pandas(), "at": seen.column("_pack").to_numpy(), "item": seen.column(I).to_pandas()})
    pairs = pairs.merge(pd.DataFrame({U: ids, "row": np.arange(len(ids))}), on=U).sort_values("at", kind="stable")
    return [t.column("_s")[0].as_py(), ids.tolist(), users.column("_hi").to_pylist(), _numbers(users.column("factor")).tobytes() if len(ids) else b"",
            pairs["row"].tolist(), pairs["at"].tolist(), pairs["item"].tolist()]


def _top(score: np.ndarray, k: int, eps: float) -> np.ndarray:
    """Mask of the best ``k`` columns of each row; ties at the edge go by column."""
    edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None] if score.shape[1] > k else np.full((len(score), 1), LEAST)
    over, tied = score > edge + eps, np.abs(score - edge) <= eps
    return over | (tied & (tied.cumsum(1) <= k - over.sum(1, keepdims=True)))


class _Slice:
    """One slice of users and the best products found for it so far."""

    def __init__(self, row: dict, k: int):
        self.users, self.hi, self.k = pa.array(row["_users"], pa.string()), np.array(row["_hi"], np.int64), k
        self.v = np.frombuffer(row["_uv"], np.float64).reshape(len(self.users), -1) if len(self.users) else np.zeros((0, 1))
        self.row, self.at, self.item = np.array(row["_row"], np.int64), np.array(row["_at"], np.int64), np.array(row["_item"], object)
        norms = np.sqrt((self.v ** 2).sum(1))
        self.norms, self.norm = np.where(norms > TINY, norms, 1.0), norms.max(initial=0.0)
        with np.errstate(all="ignore"):  # of use where all is finite
            self.unit = (self.v / self.norms[:, None]).astype(np.float32)
        self.best = np.full((len(self.users), k), LEAST)  # ascending: the first is the k-th best
        self.found, self.held = [], 0

    def meet(self, pack: int, first: int, ids: pa.Array, blob: bytes) -> None:
        v = np.frombuffer(blob, np.float64).reshape(len(ids), -1)
        rows = np.flatnonzero(self.hi > first)
        lo, hi = np.searchsorted(self.at, [pack, pack + 1])
        shut = None
        if hi > lo:
            shut = pd.DataFrame({"i": self.item[lo:hi], "row": self.row[lo:hi]}).merge(
                pd.DataFrame({"i": ids.to_pandas(), "col": np.arange(len(ids))}), on="i")
            shut = shut["row"].to_numpy(), shut["col"].to_numpy()
        most = np.sqrt((v ** 2).sum(1).max())
        eps = 1e-13 * self.norm * most
        # single precision finds what may be among the best, by vectors of length 1 at most: a product is off by less than ``miss``
        single, miss = np.isfinite(eps) and most > TINY, (v.shape[1] + 16) * 2.0 ** -23
        small = (v / most).astype(np.float32) if single else None
        for a in range(0, len(rows), ROWS):
            r = rows[a:a + ROWS]
            s = self.unit[r] @ small.T if single else self._products(r, v)
            if shut is not None:
                at = np.searchsorted(r, shut[0])
                mine = (at < len(r)) & (r[np.minimum(at, len(r) - 1)] == shut[0])
                s[at[mine], shut[1][mine]] = -np.inf
            if single:
                with np.errstate(over="ignore"):
                    edge = np.maximum((self.best[r, :1] / self.norms[r, None] / most - miss).astype(np.float32), np.finfo(np.float32).min)
                near = np.flatnonzero(s.max(axis=1) >= edge[:, 0])
                r, s, edge = r[near], s[near], edge[near]
                new = np.flatnonzero(self.best[r, 0] == LEAST)
                if len(new) and s.shape[1] > self.k:  # nothing to beat yet
                    edge[new] = np.maximum(edge[new], np.partition(s[new], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None] - 2 * miss)
            else:
                edge = np.maximum(self.best[r, :1], LEAST)
            hit = s >= edge
            at, col = np.nonzero(hit)
            many = np.flatnonzero(np.bincount(at, minlength=len(r)) > 4 * self.k)
            if len(many):
                if single and s.shape[1] > self.k:
                    best = s[many]
                    hit[many] &= best >= np.partition(best, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None] - 2 * miss
                    many = many[hit[many].sum(axis=1) > 4 * self.k]
                if len(many):  # about equal ones, in double precision
                    full = s[many] if not single else np.where(np.isneginf(s[many]), -np.inf, self._products(r[many], v))
                    hit[many] &= _top(full, self.k, eps if single else 0.0)
                at, col = np.nonzero(hit)
            if len(at):
                # once more product by product, so that equal vectors have equal products wherever they lie
                self._add(r, at, np.einsum("ij,ij->i", self.v[r[at]], v[col]), ids.take(pa.array(col)))

    def _products(self, r, v) -> np.ndarray:
        s = self.v[r] @ v.T
        s[~np.isfinite(s)] = -np.inf
        return s

    def _add(self, r, at, raw, items) -> None:
        order = np.lexsort((-raw, at))
        pos = np.arange(len(at)) - np.searchsorted(at, at)
        keep = pos < self.k
        new = np.full((len(r), self.k), LEAST)
        new[at[keep], pos[keep]] = raw[order][keep]
        touched = np.unique(at)
        self.best[r[touched]] = np.sort(np.concatenate([self.best[r[touched]], new[touched]], axis=1), axis=1)[:, self.k:]
        self.found.append(pa.table({"row": r[at], I: items, "raw": raw}))
        self.held += len(at)
        if self.held > 16 * self.k * len(self.users):
            self.found = [self._kept()]
            self.held = self.found[0].num_rows

    def _kept(self) -> pa.Table:
        t = pa.concat_tables(self.found)
        t = t.filter(pa.array(t.column("raw").to_numpy() >= self.best[t.column("row").to_numpy(), 0]))
        t = t.sort_by([("row", "ascending"), ("raw", "descending"), (I, "ascending")])
        row = t.column("row").to_numpy()
        return t.filter(pa.array(np.arange(len(row)) - np.searchsorted(row, row) < self.k))

    def rows(self):
        if self.found:
            t = self._kept().combine_chunks()
            yield pa.RecordBatch.from_arrays([self.users.take(t.column("row").combine_chunks()), t.column(I).combine_chunks(),
                                              t.column("raw").combine_chunks()], names=[U, I, "raw"])


def _score(k: int):
    """Slices of users meet packs of items: the best ``k`` of a run of packs for each user."""
    def run(batches):
        now, held = None, None
        for batch in batches:
            for t in range(batch.num_rows):
                if (s := batch.column("_s")[t].as_py()) != now:
                    if held is not None:
                        yield from held.rows()
                    now, held = s, _Slice({c: batch.column(c)[t].as_py() for c in _USERS.names}, k)
                held.meet(batch.column("_pack")[t].as_py(), batch.column("_first")[t].as_py(), batch.column("_ids")[t].values, batch.column("_iv")[t].as_py())
        if held is not None:
            yield from held.rows()
    return run


def _best(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(U).orderBy(F.desc("raw"), F.asc(I))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _score_blocks(users: DataFrame, items: DataFrame, seen: DataFrame | None, k: int, slices: int, block: int, shape: tuple) -> DataFrame:
    """The best ``k`` for users (user_id, factor, _lo, _n: the blocks _lo .. _lo + _n - 1) among items (item_id, factor, _b).

    Items lie in packs of whole blocks, users in slices, one row each, written
    once. Every part of the slices meets every part of the packs (a part of the
    packs is at most ``PART_BYTES``), so vectors are shuffled once, whatever their number,
    and k candidates a user leave each part of the packs. ``shape``: items and numbers in a vector.
    """
    spark = users.sparkSession
    n, d = shape
    per = max(1, min(PACK, PACK_BYTES // (8 * max(1, d))) // block)
    packs, cores = max(1, -(-n // (block * per))), spark.sparkContext.defaultParallelism
    parts = min(packs, max(-(-8 * n * d // PART_BYTES), -(-2 * cores // slices)))
    pack = F.floor(F.col("_b") / per).cast("int").alias("_pack")
    s_of = F.pmod(F.xxhash64(U), F.lit(slices)).cast("int").alias("_s")
    left = users.where("factor is not null").select(s_of, U, "factor", (F.col("_lo") + F.col("_n")).cast("int").alias("_hi"),
                                                    F.lit(None).cast("int").alias("_pack"), F.lit(None).cast("string").alias(I))
    if seen is not None:
        here = seen.join(users.select(U, "_lo", "_n").distinct(), U).where("_b >= _lo and _b < _lo + _n")
        left = left.unionByName(here.select(s_of, U, F.lit(None).cast("array<double>").alias("factor"), F.lit(None).cast("int").alias("_hi"), pack, I))
    spread = max(1, min(slices, -(-4 * cores // parts)))
    with batch_bytes(spark, BATCH_BYTES):
        right = items.select(pack, "_b", I, "factor").repartitionById(parts, F.pmod("_pack", F.lit(parts)))
        right = materialize(right.sortWithinPartitions("_pack", I).mapInArrow(_packed([_ITEMS, _item_row], "_pack"), "_pack int, _first int, _ids array<string>, _iv binary"))
        left = left.repartitionById(spread, F.pmod("_s", F.lit(spread)))
        left = materialize(left.sortWithinPartitions("_s", U).mapInArrow(
            _packed([_USERS, _user_row], "_s"), "_s int, _users array<string>, _hi array<int>, _uv binary, _row array<int>, _at array<int>, _item array<string>"))
        return materialize(_best(left.crossJoin(right).mapInArrow(_score(k), f"{U} string, {I} string, raw double"), k))


def top_k_dot(user_factors: DataFrame, item_factors: DataFrame, k: int, seen: DataFrame | None = None,
              block: int = 2048, users: int = 4096, report: list | None = None) -> DataFrame:
    """R-2: per user the k best items by u.v (ties item_id), seen items masked.

    Items lie in blocks by descending norm, so a user's product with anything
    from block b on is at most |u| x (largest norm of b). Rounds take the first
    block, then up to ``GROWTH`` times as many as before; after each, a user
    goes on only to the blocks whose bound reaches the k-th best product found
    so far, and a user none of them reaches is done. The result is exact: a block that could
    hold a tie is read. Where all norms are about equal the bound says nothing
    and one round reads every block, without ordering the items.

    Blocks lie in packs, users in slices; both are shuffled and written once and
    then meet (``_score_blocks``). Seen pairs go with the slice of their user and are
    masked in the pack of their item; only k candidates per user leave a run of packs.
    The largest norms of the blocks, at most ``MAX_BLOCKS`` numbers, are one
    row that every user meets.

    ``report``, if given, gets one (users, user-block visits, blocks) per round.
    Output (user_id, rank, item_id, raw).
    """
    ship_package(user_factors.sparkSession)
    norm = F.sqrt(F.aggregate("factor", F.lit(0.0), lambda a, x: a + x * x))
    uf = user_factors.select(F.col("id").cast("string").alias(U), F.col("factor").cast("array<double>").alias("factor"))
    vf = item_factors.select(F.col("id").cast("string").alias(I), F.col("factor").cast("array<double>").alias("factor"))
    if seen is not None:
        seen = seen.select(F.col(U).cast("string").alias(U), F.col(I).cast("string").alias(I)).distinct()
    n_users = uf.count()
    n, least, most, d = vf.agg(F.count(F.lit(1)), F.min(norm), F.max(norm), F.max(F.size("factor"))).first()
    least, most, d = least or 0.0, most or 0.0, d or 1
    block = max(block, -(-n // MAX_BLOCKS))
    nb, ns = max(1, -(-n // block)), max(1, -(-n_users // users))
    if nb == 1 or least >= 0.999 * most:
        b_of = F.pmod(F.xxhash64(I), F.lit(nb)).cast("int")
        every = uf.withColumn("_lo", F.lit(0)).withColumn("_n", F.lit(nb))
        if report is not None:
            report.append((n_users, n_users * nb, nb))
        return _score_blocks(every, vf.withColumn("_b", b_of), None if seen is None else seen.withColumn("_b", b_of), k, ns, block, (n, d))

    ranked = global_rank(vf.withColumn("_norm", norm), [F.desc("_norm"), F.asc(I)], "_g")
    items = ranked.withColumn("_b", F.floor((F.col("_g") - 1) / block).cast("int")).drop("_g")
    edges = materialize(items.groupBy("_b").agg(F.max("_norm").alias("_norm")))
    if seen is not None:
        seen = materialize(seen.join(items.select(I, "_b"), I))
    uf = uf.withColumn("_norm", norm)
    found, lo, hi = None, 0, 1
    while lo < nb:
        reach = F.lit(1)
        asked = uf.groupBy(U).agg(F.max("_norm").alias("_norm"))  # an id may come twice
        if found is not None:
            bar = found.groupBy(U).agg(F.when(F.count(F.lit(1)) >= k, F.min("raw")).alias("_bar"))
            row = edges.where((F.col("_b") >= lo) & (F.col("_b") < hi)).agg(F.array_sort(F.collect_list("_norm")).alias("_edges"))
            asked = asked.join(bar, U, "left").crossJoin(F.broadcast(row))  # one row of at most MAX_BLOCKS numbers
            reach = F.size(F.filter("_edges", lambda x: F.col("_bar").isNull() | (x * F.col("_norm") * SLACK >= F.col("_bar"))))
        asked = materialize(asked.select(U, F.lit(lo).alias("_lo"), reach.alias("_n")).where("_n > 0"))
        left, visits, far = asked.agg(F.count(F.lit(1)), F.sum("_n"), F.max("_n")).first()
        if report is not None:
            report.append((left, visits or 0, nb))
        if not left:
            break
        here = items.where((F.col("_b") >= lo) & (F.col("_b") < lo + far))
        new = _score_blocks(uf.select(U, "factor").join(asked, U), here, seen, k, max(1, -(-left // users)), block, (min(n, far * block), d))
        found = new if found is None else materialize(_best(found.unionByName(new).drop("rank"), k))
        lo, hi = hi, hi * GROWTH
    return found


# ---------------------------------------------------------------- C-8 / C-10

def _matrix(column: pa.Array, p: int) -> np.ndarray:
    """The vectors of a column: arrays of one each, or packs of many."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, p)
    return column.flatten().to_numpy().reshape(-1, p)


def _times(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every row vector times a small (at most a few dozen squared) matrix."""
    p, kind = matrix.shape[0], vectors.schema["vec"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows and kind == "binary":
                rows = pa.array([(np.frombuffer(x.as_buffer(), np.float64).reshape(-1, p) @ matrix).tobytes() for x in batch.column("vec")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), rows], names=["id", "vec"])
            elif batch.num_rows:
                m = _matrix(batch.column("vec"), p) @ matrix
                rows = pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), rows], names=["id", "vec"])
    return vectors.select("id", "vec").mapInArrow(run, f"id string, vec {kind}")


def _summed(t: pa.Table) -> pa.Table:
    """(id, vec): one row an id, the sum of its vectors."""
    ids = t.column("id").combine_chunks().dictionary_encode()
    code = ids.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    m = np.add.reduceat(t.column("vec").combine_chunks().flatten().to_numpy().reshape(len(code), -1)[order], first)
    return _vector_rows(ids.dictionary.take(pa.array(code[order][first])), m)


def _vector_rows(ids: pa.Array, m: np.ndarray) -> pa.Table:
    return pa.table({"id": ids, "vec": pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel()))})


def _sums(held_rows: int = 1 << 15):
    """Weighted sums by id of (id, w, vec); at most about ``held_rows`` are held, and sent on where they are of as many ids."""
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1) * batch.column("w").to_numpy()[:, None]
            held.append(_summed(_vector_rows(batch.column("id"), m)))
            rows += held[-1].num_rows
            if rows > held_rows:
                held = [_summed(pa.concat_tables(held))]
                rows = held[0].num_rows
                if rows > held_rows // 2:
                    yield from held.pop().to_batches()
                    rows = 0
        if held:
            yield from _summed(pa.concat_tables(held)).to_batches()
    return run


def _product(cells: DataFrame, vectors: DataFrame, by: str, to: str) -> DataFrame:
    """Rows of the matrix product: sum over ``by`` of weight x vector, per ``to``; partial sums before the shuffle."""
    parts = cells.join(vectors.withColumnRenamed("id", by), by).select(F.col(to).alias("id"), "w", "vec").where("id is not null and w is not null").mapInArrow(
        _sums(), "id string, vec array<double>")
    return parts.groupBy("id").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec"))


#: Vectors in a pack of the SVD; bytes of the sums that a task of a product holds.
SVD_PACK, SVD_BYTES = 4096, 96 << 20


class _Blocks:
    """The matrix, cut into blocks of rows and packs of columns, and both ways of multiplying it by packs of vectors.

    ``cells`` (u, i, w) is numbered by the sorted ids. A product has one task for a block of rows: it holds their sums, while packs of
    vectors and the cells of the block in them pass. So a vector is sent once for every block, not once for every cell, and no sum
    leaves a task before it is whole. Packs are rows (id, vec): the number of the pack, and up to ``SVD_PACK`` vectors."""

    def __init__(self, cells: DataFrame, p: int, counts: tuple[int, int]):
        self.p, cores = p, cells.sparkSession.sparkContext.defaultParallelism
        cells = cells.where("u is not null and i is not null and w is not null")
        self.ids, self.n, self.size = {}, dict(zip("ui", counts, strict=True)), {}
        for c in "ui":
            self.ids[c] = materialize(global_rank(cells.select(F.col(c).alias("id")).distinct(), [F.asc("id")], "idx").select("id", (F.col("idx") - 1).alias("idx")))
            self.n[c] = self.ids[c].count()
            self.size[c] = self.rows_of(self.n[c], p, cores)
        named = cells
        for c in "ui":
            named = named.join(self.ids[c].select(F.col("id").alias(c), F.col("idx").alias(f"_{c}")), c)
        named = stored(named.select("_u", "_i", "w"), "cells")
        self.cells = {"u": self._cut(named, "u", "i"), "i": self._cut(named, "i", "u")}

    @staticmethod
    def rows_of(n: int, p: int, cores: int) -> int:
        """Rows of a block, a multiple of a pack: a task's share, as far as the sums fit ``SVD_BYTES``."""
        most = max(1, SVD_BYTES // (8 * p * SVD_PACK))
        return SVD_PACK * max(1, min(most, -(-n // (cores * SVD_PACK))))

    @staticmethod
    def pays(n_cells: int, counts: tuple[int, int], p: int, cores: int) -> bool:
        """Whether vectors are sent less often by block than by cell, in both products."""
        return all(-(-n // _Blocks.rows_of(n, p, cores)) * other <= n_cells for n, other in (counts, counts[::-1]))

    def _blocks(self, c: str) -> int:
        return max(1, -(-self.n[c] // self.size[c]))

    def _cut(self, named: DataFrame, to: str, by: str) -> DataFrame:
        size, number = self.size[to], lambda c, n: F.floor(F.col(c) / n).cast("int")
        rows = named.select(number(f"_{to}", size).alias("block"), number(f"_{by}", SVD_PACK).alias("pack"),
                            (F.col(f"_{to}") % size).cast("int").alias("r"), (F.col(f"_{by}") % SVD_PACK).cast("int").alias("c"), "w")

        def run(batches):
            for batch in batches:
                block, pack = batch.column("block").to_numpy(), batch.column("pack").to_numpy()
                edges = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(pack) != 0), True]) if batch.num_rows else [0]
                blobs = [[batch.column(x).to_numpy()[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:], strict=True)] for x in ("r", "c", "w")]
                yield pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]], pa.int32()), pa.array(pack[edges[:-1]], pa.int32()),
                                                  *[pa.array(x, pa.binary()) for x in blobs]], names=["block", "pack", "r", "c", "w"])

        dealt = rows.repartitionById(self._blocks(to), F.col("block")).sortWithinPartitions("block", "pack", "r")
        return stored(dealt.mapInArrow(run, "block int, pack int, r binary, c binary, w binary"), "svd-cells")

    def packs(self, vectors: DataFrame, c: str) -> DataFrame:
        """(id, vec) by id as packs."""
        p = self.p

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by("idx")
            m = t.column("vec").combine_chunks().flatten().to_numpy()
            return pa.table({"id": [str(t.column("idx")[0].as_py() // SVD_PACK)], "vec": pa.array([m.tobytes()], pa.binary())})

        rows = self.ids[c].join(vectors, "id").select("idx", "vec")
        return rows.groupBy(F.floor(F.col("idx") / SVD_PACK)).applyInArrow(pack, "id string, vec binary")  # SVD_PACK rows a group

    def rows(self, packs: DataFrame, c: str, p: int) -> DataFrame:
        """Packs as (id, vec) by id."""
        def run(batches):
            for batch in batches:
                for x, v in zip(batch.column("id").to_pylist(), batch.column("vec"), strict=True):
                    m = np.frombuffer(v.as_buffer(), np.float64).reshape(-1, p)
                    yield from pa.table({"idx": pa.array(np.arange(len(m)) + int(x) * SVD_PACK), "vec": pa.ListArray.from_arrays(
                        np.arange(0, m.size + 1, p, dtype=np.int32), pa.array(m.ravel()))}).to_batches()
        return packs.mapInArrow(run, "idx long, vec array<double>").join(self.ids[c], "idx").select("id", "vec")

    def product(self, vectors: DataFrame, to: str) -> DataFrame:
        """Sums of weight x vector, as packs of ``to``."""
        n, size, p, blocks = self.n[to], self.size[to], self.p, self._blocks(to)
        none = [F.lit(None).cast("binary").alias(x) for x in ("r", "c", "w")]
        rows = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("id").cast("int").alias("pack"), F.lit(0).alias("kind"), "vec", *none)
        rows = rows.unionByName(self.cells[to].select("block", "pack", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("vec"), "r", "c", "w"))

        def run(batches):
            now, total, v = None, None, None

            def packs():
                for x in range(0, len(total), SVD_PACK):
                    yield pa.RecordBatch.from_arrays([pa.array([str((now * size + x) // SVD_PACK)]), pa.array([total[x : x + SVD_PACK].tobytes()], pa.binary())],
                                                     names=["id", "vec"])

            for batch in batches:
                for t in range(batch.num_rows):
                    if (block := batch.column("block")[t].as_py()) != now:
                        if now is not None:
                            yield from packs()
                        now, total = block, None
                        total = np.zeros((max(0, min(size, n - now * size)), p))
                    read = lambda x, kind: np.frombuffer(batch.column(x)[t].as_buffer(), kind)  # noqa: B023,E731
                    if batch.column("kind")[t].as_py() == 0:
                        v = read("vec", np.float64).reshape(-1, p).copy()
                        continue
                    r = read("r", np.int32)  # in order
                    first = np.flatnonzero(np.diff(r, prepend=-1))
                    parts = v.take(read("c", np.int32), axis=0)
                    parts *= read("w", np.float64)[:, None]
                    total[r[first]] += parts if len(first) == len(r) else np.add.reduceat(parts, first, axis=0)
            if now is not None:
                yield from packs()

        dealt = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "pack", "kind")
        return dealt.mapInArrow(run, "id string, vec binary")


def _stored(vectors: DataFrame) -> tuple[DataFrame, str]:
    """Vectors written to the shared folder, and their path."""
    vectors.write.parquet(at := scratch_path(vectors.sparkSession, "svd"))
    return vectors.sparkSession.read.schema(vectors.schema).parquet(at), at


def _gram(vectors: DataFrame, p: int) -> np.ndarray:
    """V^T V: p x p numbers, summed in the tasks."""
    def run(batches):
        total = np.zeros((p, p))
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("vec"), p)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([i for i in range(p)], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         names=["i", "row"])
    parts = vectors.select("vec").mapInArrow(run, "i int, row array<double>")
    rows = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # p x p
    g = np.zeros((p, p))
    for r in rows:
        g[r["i"], r["j"]] = r["x"]
    return g


def _whiten(g: np.ndarray) -> np.ndarray:
    """M with M^T G M = 1 on the directions that are there (others become 0)."""
    values, w = np.linalg.eigh((g + g.T) / 2)
    scale = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return w * scale


def svd_fit(inter: DataFrame, k: int = 50, user: str = U, item: str = I, iterations: int = 10, oversample: int = 10):
    """C-8: truncated SVD of the user x item weight matrix by randomised subspace iteration.

    The item vectors (k + ``oversample`` numbers each) and the user vectors are
    DataFrames; a product with the matrix goes by blocks (``_Blocks``), or, where there are so many blocks
    that vectors would be sent more often than by cell, is a join and a grouped vector sum.
    Only the vectors' small Gram matrix comes to the driver. Start vectors are
    hashes of the ids, so a run is repeatable. Each product is written by itself;
    its shuffle files go with its job, and the vectors of a round with the next,
    so disk holds one product whatever the number of iterations. Returns (user_factors,
    item_factors, evr) with user = U*S and item = V, both L2-normalised, sign
    fixed so each component's largest |user loading| is positive
    (deterministic, quirk 18).
    """
    spark = inter.sparkSession
    ship_package(spark)
    cells = stored(inter.select(F.col(user).cast("string").alias("u"), F.col(item).cast("string").alias("i"),
                                F.col("weight").cast("double").alias("w")), "svd-matrix")
    n_users, n_items = cells.select("u").distinct().count(), cells.select("i").distinct().count()
    k = max(1, min(k, min(n_users, n_items) - 1))
    p = min(k + oversample, n_users, n_items)
    uniform = lambda j, s: (F.pmod(F.xxhash64("id", j, F.lit(s)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = F.transform(F.sequence(F.lit(1), F.lit(p)), lambda j: F.sqrt(-2 * F.log(uniform(j, 1))) * F.cos(2 * np.pi * uniform(j, 2)))
    q = cells.select(F.col("i").alias("id")).distinct().select("id", normal.alias("vec"))
    last, blocks = None, None
    with shuffles_removed(spark), batch_bytes(spark, BATCH_BYTES):
        if _Blocks.pays(cells.count(), (n_users, n_items), p, spark.sparkContext.defaultParallelism):
            blocks = _Blocks(cells, p, (n_users, n_items))
            q, last = _stored(blocks.packs(q, "i"))
        by_user = lambda q: blocks.product(q, "u") if blocks else _product(cells, q, "i", "u")
        by_item = lambda y: blocks.product(y, "i") if blocks else _product(cells, y, "u", "i")
        for _ in range(iterations):
            y, y_at = _stored(by_user(q))
            z, z_at = _stored(by_item(y))
            for at in filter(None, (y_at, last)):
                remove_path(spark, at)
            last = z_at
            q = _times(z, _whiten(_gram(z, p)))
        q, q_at = _stored(q)
        if last:
            remove_path(spark, last)
        last, q = q_at, materialize(_times(q, _whiten(_gram(q, p))))  # once more: exactly orthonormal
        remove_path(spark, last)
        y, y_at = _stored(by_user(q))
        values, w = np.linalg.eigh(_gram(y, p))
        w = w[:, np.argsort(-values)[:k]]
        us = _times(y, w)  # U * S
        us = materialize(blocks.rows(us, "u", k) if blocks else us)
        remove_path(spark, y_at)
    mx = us.select(F.posexplode("vec").alias("c", "x")).groupBy("c").agg(F.max_by("x", F.abs("x")).alias("xm")).collect()  # k rows
    signs = np.ones(k)
    for r in mx:
        signs[r["c"]] = -1.0 if r["xm"] < 0 else 1.0
    user_f = l2_normalize(_times(us, np.diag(signs)).select("id", F.col("vec").alias("factor")))
    item_v = _times(q, w * signs)
    item_f = l2_normalize((blocks.rows(item_v, "i", k) if blocks else item_v).select("id", F.col("vec").alias("factor")))
    return user_f, item_f, explained_variance_ratio(cells, us, n_users)


def explained_variance_ratio(cells: DataFrame, us: DataFrame, n_users: int) -> float:
    """C-10: sum of var(U*S columns) / sum of var(X columns), by aggregates."""
    m = float(n_users)
    col = cells.groupBy("i").agg(F.sum("w").alias("s1"), F.sum(F.col("w") ** 2).alias("s2"))
    tot = col.agg(F.sum(F.col("s2") / m - (F.col("s1") / m) ** 2).alias("v")).collect()[0]["v"] or 0.0
    comp = us.select(F.posexplode("vec").alias("c", "x")).groupBy("c").agg(
        (F.sum(F.col("x") ** 2) / m - (F.sum("x") / m) ** 2).alias("v"))
    exp = comp.agg(F.sum("v").alias("v")).collect()[0]["v"] or 0.0
    return float(exp / tot) if tot > 0 else 0.0
