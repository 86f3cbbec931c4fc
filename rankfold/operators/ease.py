"""EASE item-item model (C-5..C-7, R-1) as Spark jobs.

* ``active_items``: items with positive total weight, capped by total weight.
* ``gram``: G = X^T X over active items, i <= j only (mirrored afterwards). Work
  is sum_u |h_u|^2, bounded per user by the active item cap. Few items: a self join
  on user; many: each item goes with the items after it to where it is summed.
  Heavy users are salted: a user's rows on the left are spread over
  ``ceil(n_u / chunk)`` salts and the right side is replicated only for that
  user, so no single task multiplies one hot user's whole history.
* ``ease_fit``: P = (G + lambda I)^-1 on the dense tiles of the lower triangle,
  by symmetric block elimination (``inverse_tiles``). B_ij = -P_ij / P_jj, B_jj = 0.
  Where users are fewer than items, the smaller K = X X^T + lambda I over users is
  inverted instead: lambda P = 1 - X^T K^-1 X (``DualWeights``).
* ``Weights``: the fitted B as a store of tiles. Scoring sends every column block
  once and runs the users past it; single entries are looked up by tile. The
  long table (src, dst, weight) is made only where someone asks for it.
* ``score_ease``: score(u, j) = sum_i w(u, i) B(i, j) as join + aggregate.

What a task holds is bounded whatever the catalog: a few tiles (``inverse_tiles``),
or one column block and one slice of users (``score_ease_topk``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.config import DEFAULTS
from rankfold.session import batch_bytes, materialize, remove_path, scratch_path, ship_package, shuffles_removed, stored

U, I = "user_id", "item_id"


def active_items(train: DataFrame, max_items: int | None = None) -> DataFrame:
    """C-5: items with sum(weight) > 0; with ``max_items``, the heaviest ones (ties item_id)."""
    max_items = DEFAULTS.ease_max_items if max_items is None else max_items
    s = train.groupBy(I).agg(F.sum("weight").alias("total")).where(F.col("total") > 0)
    if max_items is not None:
        from rankfold.operators.ranking import top_n
        s = top_n(s, max_items, [F.desc("total"), F.asc(I)])
    return s


def gram(hist: DataFrame, active: DataFrame | None = None, l2: float | None = None,
         mirror: bool = True, chunk: int = 1024) -> DataFrame:
    """C-6 / J-5: (i, j, g) with g = sum_u w(u,i) w(u,j) (+ l2 on the diagonal)."""
    h = hist.select(U, I, F.col("weight").cast("double").alias("w"))
    if active is not None:
        h = h.join(active.select(I), I, "left_semi")  # AQE broadcasts it when small
    h = h.where(F.col(U).isNotNull() & F.col(I).isNotNull())
    n_u = materialize(h.groupBy(U).agg(F.count(F.lit(1)).alias("_nu")))
    pairs, longest = n_u.agg(F.sum(F.col("_nu") * (F.col("_nu") + 1) / 2), F.max("_nu")).first()
    n_i = h.groupBy(I).agg(F.count(F.lit(1)).alias("_ni"))
    kinds = n_i.count()
    if (pairs or 0) > kinds * (kinds + 1):  # few items: most products fall together before the shuffle
        rows = _products(h, n_u, chunk)
        g = rows.groupBy("i", "j").agg(F.sum(F.col("_wi") * F.col("_wj")).alias("g"))
    else:
        g = _gram_by_item(h, n_u, n_i, int(pairs or 0), longest or 0, chunk)
    if mirror:
        g = g.unionByName(g.where(F.col("i") != F.col("j"))
                          .select(F.col("j").alias("i"), F.col("i").alias("j"), "g"))
    if l2:
        g = g.withColumn("g", F.when(F.col("i") == F.col("j"), F.col("g") + F.lit(float(l2))).otherwise(F.col("g")))
    return g



def _products(h: DataFrame, n_u: DataFrame, chunk: int) -> DataFrame:
    """(i, j, _wi, _wj): every pair i <= j of a user's items, by a salted self join."""
    h = h.join(n_u, U).withColumn("_s", F.greatest(F.lit(1), F.ceil(F.col("_nu") / F.lit(chunk))).cast("int"))
    left = h.withColumn("_salt", F.pmod(F.xxhash64(I), F.col("_s")).cast("int"))
    right = h.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    a, b = left.alias("a"), right.alias("b")
    pairs = a.join(b, (F.col("a." + U) == F.col("b." + U)) & (F.col("a._salt") == F.col("b._salt"))
                   & (F.col("a." + I) <= F.col("b." + I)))
    return pairs.select(F.col("a." + I).alias("i"), F.col("b." + I).alias("j"), F.col("a.w").alias("_wi"), F.col("b.w").alias("_wj"))


def _gram_by_item(h: DataFrame, n_u: DataFrame, n_i: DataFrame, pairs: int, longest: int, chunk: int) -> DataFrame:
    """(i, j, g) where pairs of items are many: a user sends item i once, with the items from i on, and the products
    are made and summed where all rows of i are. Rows of users longer than ``chunk`` come from the salted join; items of more
    than ``HOT_ITEM`` users are dealt by parts of their partners. There is one partition for ``PAIRS`` products. Beyond
    ``ROUND_PAIRS`` products the items go in up to ``ROUNDS`` jobs, each written: the shuffle files of one, the larger part of
    the disk, are gone before the next."""
    light = h if longest <= chunk else h.join(n_u.where(F.col("_nu") <= chunk), U, "left_semi")
    packed = light.groupBy(U).agg(F.sort_array(F.collect_list(F.struct(I, "w"))).alias("_h"))  # at most ``chunk`` items
    packed = packed.select(F.transform("_h", lambda x: x[I]).alias("_items"), F.transform("_h", lambda x: x["w"]).alias("_ws"))
    hot = n_i.where(F.col("_ni") > HOT_ITEM).select(F.col(I).alias("i"), F.ceil(F.col("_ni") / HOT_ITEM).cast("int").alias("_n"))
    rounds = max(1, min(ROUNDS, pairs // ROUND_PAIRS))
    if rounds == 1:
        return _summed_by_item(h, n_u, packed, hot, pairs, longest, chunk)
    spark, at = h.sparkSession, scratch_path(h.sparkSession, "gram")
    with shuffles_removed(spark):
        packed, hot = stored(packed, "histories"), materialize(hot)
        for k in range(rounds):
            mine = F.pmod(F.xxhash64("i"), F.lit(rounds)) == k
            _summed_by_item(h, n_u, packed, hot, pairs // rounds, longest, chunk, mine).write.mode("append").parquet(at)
    return spark.read.schema("i string, j string, g double").parquet(at)


def _summed_by_item(h: DataFrame, n_u: DataFrame, packed: DataFrame, hot: DataFrame, pairs: int, longest: int, chunk: int, mine=None) -> DataFrame:
    """``_gram_by_item`` for the items i of which ``mine`` holds."""
    mine = F.lit(True) if mine is None else mine
    one = packed.select("_items", "_ws", F.posexplode("_items").alias("_pos", "i")).where(mine)
    # from the first row of the item on: a pair that comes twice counts as often as in the join
    tail = lambda c: F.slice(c, F.array_position("_items", F.col("i")).cast("int"), F.size("_items"))
    rows = one.select("i", F.get("_ws", F.col("_pos")).alias("_wi"), tail("_items").alias("_of"), tail("_ws").alias("_wof"))
    if longest > chunk:
        heavy = n_u.where(F.col("_nu") > chunk)
        rows = rows.unionByName(_products(h.join(heavy, U, "left_semi"), heavy, chunk).where(mine).select(
            "i", "_wi", F.array("j").alias("_of"), F.array("_wj").alias("_wof")))
    rows = rows.join(F.broadcast(hot), "i", "left")  # at most the number of rows / HOT_ITEM
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)))
    some = F.filter(F.arrays_zip("_of", "_wof"), lambda y: F.pmod(F.xxhash64(y["_of"]), F.col("_n")) == F.col("_part"))
    rows = rows.withColumn("_some", F.when(F.col("_n").isNotNull(), some))
    dealt_out = lambda c: F.when(F.col("_n").isNull(), F.col(c)).otherwise(F.transform("_some", lambda y: y[c])).alias(c)
    rows = rows.select("i", "_part", "_wi", dealt_out("_of"), dealt_out("_wof"))
    dealt = rows.repartition(max(1, -(-pairs // PAIRS)), "i", "_part")
    each = dealt.select("i", "_part", "_wi", "_wof", F.posexplode("_of").alias("_k", "j")).select(
        "i", "_part", "j", (F.col("_wi") * F.get("_wof", F.col("_k"))).alias("_x"))
    return each.groupBy("i", "_part", "j").agg(F.sum("_x").alias("g")).select("i", "j", "g")


#: Products that a partition of ``_gram_by_item`` sums, and users of an item from which on its partners are dealt out.
PAIRS, HOT_ITEM = 1 << 21, 50_000
#: Jobs that share a large Gram, and products of one at least.
ROUNDS, ROUND_PAIRS = 16, 1 << 24
#: Looked-up weights that are broadcast to their pairs.
FOUND = 100_000

_TILE = "i int, j int, a binary"
#: Bytes of column tiles that one cell of the grid holds; sets the number of cells.
CELL_BYTES = 56 << 20
#: Side of the tiles. A tile is one row of 2 MB: sorts, shuffles, files and Arrow batches
#: hold several rows per core at once, whatever a step's width.
TILE = 512
#: Items from which on ``DualWeights`` are used, users per item up to which they are, and the largest diagonal entry of the
#: Gram, as a multiple of lambda, up to which 1 - x^T K^-1 x keeps ten digits.
DUAL_FROM, DUAL_SHARE, DUAL_RATIO = 4096, 0.8, 1e6
#: Bytes of a dense block that a task holds, and entries whose rows are multiplied at once.
DUAL_BYTES, DUAL_ENTRIES = 64 << 20, 4096
#: Parts by item that the entries of a block of users are packed in.
SPLIT = 8
#: Bytes of K^-1 X that a round writes, at least; else half of K^-1.
ROUND_BYTES = 384 << 20
#: Bytes of an Arrow batch of tiles, and tiles of a row group: a writer and a reader hold one.
BATCH_BYTES, ROW_GROUP = 4 << 20, 4
#: Jobs that share a step of the elimination, or the column blocks that histories run past; bytes of tiles from which on they do.
PARTS, PART_BYTES = 6, 256 << 20


def step_tiles(n: int, tile: int) -> int:
    """Tile columns that a step takes at once: 1024 items for small catalogs, some ten steps up to 20,000 items, 2048 items beyond."""
    return max(1, min(2048, max(1024, 256 * math.ceil(n / 2560))) // tile)


def _side(k: int, n: int, tile: int) -> int:
    return min(tile, n - k * tile)


def _dense(blob, rows: int, cols: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(rows, cols)


def _tile_row(i: int, j: int, a: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([a.tobytes()], pa.binary())],
                                      names=["i", "j", "a"])


def write_tiles(tiles: DataFrame, at: str, mode: str = "error", by: str | None = None) -> str:
    """Tiles as Parquet, in row groups of a few tiles: a reader takes a row group at a time."""
    (tiles.write.mode(mode).partitionBy(*filter(None, [by])).option("compression", "none").option("parquet.enable.dictionary", "false")
        .option("parquet.block.row.count.limit", str(ROW_GROUP)).option("parquet.page.size.row.check.min", "1")
        .option("parquet.page.size.row.check.max", "1").parquet(at))
    return at


def _store(tiles: DataFrame, name: str) -> str:
    return write_tiles(tiles, scratch_path(tiles.sparkSession, name))


def gram_tiles(entries: DataFrame, n: int, tile: int) -> DataFrame:
    """(i, j, a): the lower triangle of the symmetric matrix with entries
    (r, c, g), r >= c, as dense tiles, also those without entries."""
    def build(cells: pa.Table, place: pa.Table) -> pa.Table:
        out = {"i": [], "j": [], "a": []}
        if place.num_rows:
            i, j = place.column("i")[0].as_py(), place.column("j")[0].as_py()
            m = np.zeros((_side(i, n, tile), _side(j, n, tile)))
            r, c, g = (cells.column(x).to_numpy() for x in ("r", "c", "g"))
            m[r - i * tile, c - j * tile] = g
            if i == j:
                m[c - j * tile, r - i * tile] = g
            out = {"i": [i], "j": [j], "a": [m.tobytes()]}
        return pa.table(out, schema=pa.schema([("i", pa.int32()), ("j", pa.int32()), ("a", pa.binary())]))

    nb = math.ceil(n / tile)
    of = lambda c: F.floor(F.col(c) / F.lit(tile)).cast("int")
    places = entries.sparkSession.range(nb).select(F.col("id").cast("int").alias("i")).select(
        "i", F.explode(F.sequence(F.lit(0), F.col("i"))).alias("j"))
    cells = entries.select(of("r").alias("i"), of("c").alias("j"), "r", "c", "g")
    return cells.groupBy("i", "j").cogroup(places.groupBy("i", "j")).applyInArrow(build, _TILE)


def _grid(nb: int, tile: int, cores: int, wide: int = 1) -> int:
    """Groups of tile rows: two groups' tiles of ``wide`` columns fit into CELL_BYTES, and
    there are two cells for every core."""
    return min(nb, max(math.ceil(2 * nb * wide * tile * tile * 8 / CELL_BYTES), math.ceil(math.sqrt(4 * cores))))


def _pivot(k: int, n: int, tile: int, wide: int):
    """One task: the inverse of the pivot of the tile columns k .. k + wide - 1, as tiles of its lower triangle."""
    end = min(k + wide, math.ceil(n / tile))
    at = lambda i: slice((i - k) * tile, (i - k) * tile + _side(i, n, tile))

    def run(batches):
        pivot = np.zeros((min(end * tile, n) - k * tile,) * 2)
        for batch in batches:
            for t in range(batch.num_rows):
                i, j, a = (batch.column(c)[t].as_py() for c in ("i", "j", "a"))
                pivot[at(i), at(j)] = _dense(a, _side(i, n, tile), _side(j, n, tile))
                pivot[at(j), at(i)] = pivot[at(i), at(j)].T
        root = np.linalg.inv(np.linalg.cholesky(pivot))
        pivot = root.T @ root
        for i in range(k, end):
            for j in range(k, i + 1):
                yield _tile_row(i, j, np.ascontiguousarray(pivot[at(i), at(j)]))
    return run


def _sweep(k: int, n: int, tile: int, wide: int = 1):
    """Tasks of one step, of the tile columns k .. k + wide - 1: the inverse of the pivot and a cell's copies of
    those columns come first, its tiles after them."""
    end = min(k + wide, math.ceil(n / tile))
    span = min(end * tile, n) - k * tile
    at = lambda i: slice((i - k) * tile, (i - k) * tile + _side(i, n, tile))
    inside = lambda i: k <= i < end

    def run(batches):
        now, pivot, column, scaled = None, None, {}, {}
        for batch in batches:
            for t in range(batch.num_rows):
                cell, kind, i, j = (batch.column(c)[t].as_py() for c in ("cell", "kind", "i", "j"))
                if cell != now:
                    pivot, column, scaled = None, {}, {}
                    now, pivot = cell, np.zeros((span, span))
                h, w = _side(i, n, tile), _side(j, n, tile)
                a = np.frombuffer(batch.column("a")[t].as_buffer(), np.float64).reshape(h, w)
                if kind == 0:
                    if inside(i) and inside(j):
                        pivot[at(i), at(j)] = a
                        pivot[at(j), at(i)] = a.T
                    else:  # as rows of the columns
                        row, part = (i, at(j)) if inside(j) else (j, at(i))
                        column.setdefault(row, np.empty((_side(row, n, tile), span)))[:, part] = a if inside(j) else a.T
                    continue
                if inside(i) and inside(j):
                    a = -pivot[at(i), at(j)]
                elif inside(j):
                    a = column[i] @ pivot[:, at(j)]
                else:
                    if j not in scaled and not inside(i):
                        scaled[j] = pivot @ column[j].T
                    a = pivot[at(i)] @ column[j].T if inside(i) else a - column[i] @ scaled[j]
                yield _tile_row(i, j, a)
    return run


def inverse_tiles(tiles: DataFrame, n: int, tile: int, wide: int = 1) -> str:
    """Inverse of a symmetric positive definite matrix, with the sign turned,
    from the tiles of its lower triangle; returns the path of the same tiles.

    Symmetric block elimination: a step takes ``wide`` tile columns K at once, and
    (column K of row i) (pivot)^-1 (column K of row j)^T off every tile (i, j); the
    pivot is inverted by Cholesky in one task. Only the lower triangle is kept, moved and
    multiplied: n^3 operations in all, as for a Cholesky factor and its two
    triangular solves, in ceil(n / tile / wide) steps. Tiles lie on a fixed grid of
    cells, one partition each; a step sends a cell the column tiles of its rows
    and columns, G + 1 copies of a column for G^2 / 2 cells. A step writes its columns, then
    takes the cells in up to ``PARTS`` jobs; what a job replaces goes with it, so the shared folder
    and the shuffle files hold little more than one copy. The bytes moved go by ``wide``, what a row weighs by ``tile``.
    """
    spark = tiles.sparkSession
    nb = math.ceil(n / tile)
    groups = _grid(nb, tile, spark.sparkContext.defaultParallelism, wide)
    group = lambda c: F.floor(F.col(c) * F.lit(groups) / F.lit(nb)).cast("int")
    number = lambda r, c: (r * (r + 1) / 2 + c).cast("int")
    cells = groups * (groups + 1) // 2
    parts = max(1, min(cells, PARTS, 4 * n * n // PART_BYTES))
    every = F.sequence(F.lit(0), F.lit(groups - 1))
    cell_of = lambda a, b: number(F.greatest(a, b), F.least(a, b))
    with batch_bytes(spark, BATCH_BYTES), shuffles_removed(spark):
        at = scratch_path(spark, "gram")
        write_tiles(tiles.withColumn("part", number(group("i"), group("j")) % parts), at, by="part")
        for k in range(0, nb, wide):
            now = spark.read.parquet(at).select("part", "i", "j", "a")
            in_i, in_j = (F.col(c).between(k, k + wide - 1) for c in ("i", "j"))
            pivot = now.where(in_i & in_j).select("i", "j", "a").repartition(1).mapInArrow(_pivot(k, n, tile, wide), _TILE)
            panel = _store(now.where(in_i != in_j).select("i", "j", "a").unionByName(pivot), "columns")
            line = spark.read.parquet(panel)
            line = line.withColumn("cells", F.when(in_i & in_j, F.sequence(F.lit(0), F.lit(cells - 1))).otherwise(
                F.transform(every, lambda o: cell_of(F.when(in_j, group("i")).otherwise(group("j")), o))))
            after = scratch_path(spark, "inverse")
            for part in range(parts):
                own = now.where(F.col("part") == part).select(number(group("i"), group("j")).alias("cell"), F.lit(1).alias("kind"), "i", "j", "a")
                copies = line.select(F.explode(F.filter("cells", lambda c: c % parts == part)).alias("cell"), F.lit(0).alias("kind"), "i", "j", "a")
                rows = own.unionByName(copies)
                dealt = rows.repartitionById(-(-(cells - part) // parts), F.floor((F.col("cell") - part) / parts).cast("int"))
                write_tiles(dealt.sortWithinPartitions("cell", "kind", "i", "j").mapInArrow(_sweep(k, n, tile, wide), _TILE), f"{after}/part={part}")
                remove_path(spark, f"{at}/part={part}")
            remove_path(spark, panel)
            remove_path(spark, at)
            at = after
    return at


@dataclass
class Weights:
    """EASE weights: ``items`` (item_id, idx, scale) and ``tiles`` (i, j, a), the
    dense tiles of B; ``scale`` is 1 / P_jj. Both lie in the shared folder."""
    items: DataFrame
    tiles: DataFrame
    n: int
    tile: int

    def columns(self, lo: int, hi: int) -> DataFrame:
        """The tiles of the tile columns lo .. hi."""
        return self.tiles.where(F.col("j").between(lo, hi))

    def table(self) -> DataFrame:
        """All of B as a long table (src, dst, weight) without its diagonal: n^2 rows."""
        n, tile = self.n, self.tile

        def run(batches):
            for batch in batches:
                for t in range(batch.num_rows):
                    i, j, a = (batch.column(c)[t].as_py() for c in ("i", "j", "a"))
                    h, w = _side(i, n, tile), _side(j, n, tile)
                    for lo in range(0, h, step := max(1, (1 << 17) // w)):
                        m = _dense(a, h, w)[lo : lo + step]
                        rr, cc = np.indices(m.shape)
                        rr, cc = rr + i * tile + lo, cc + j * tile
                        keep = rr != cc
                        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (rr, cc, m)], names=["r", "c", "weight"])

        long = self.tiles.mapInArrow(run, "r long, c long, weight double")
        name = lambda x, c: self.items.select(F.col(I).alias(x), F.col("idx").alias(c))
        return long.join(name("src", "r"), "r").join(name("dst", "c"), "c").select("src", "dst", "weight")

    def at(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (src, dst and others) with their ``weight``: pairs of active,
        different items only. Pairs go to their tiles; no other entry is unpacked."""
        n, tile = self.n, self.tile
        name = lambda x, c: self.items.select(F.col(I).alias(x), F.col("idx").alias(c))
        asked = pairs.select("src", "dst").distinct().where("src <> dst").join(name("src", "r"), "src").join(name("dst", "c"), "dst")
        of = lambda c: F.floor(F.col(c) / F.lit(tile)).cast("int")
        asked = asked.select(of("r").alias("i"), of("c").alias("j"), "src", "dst", "r", "c")
        out = pa.schema([("src", pa.string()), ("dst", pa.string()), ("weight", pa.float64())])

        def pick(asked: pa.Table, tiles: pa.Table) -> pa.Table:
            if not asked.num_rows or not tiles.num_rows:
                return out.empty_table()
            i, j, a = (tiles.column(c)[0].as_py() for c in ("i", "j", "a"))
            m = _dense(a, _side(i, n, tile), _side(j, n, tile))
            got = m[asked.column("r").to_numpy() - i * tile, asked.column("c").to_numpy() - j * tile]
            return pa.table([asked.column("src"), asked.column("dst"), pa.array(got)], schema=out)

        found = materialize(asked.groupBy("i", "j").cogroup(self.tiles.groupBy("i", "j")).applyInArrow(pick, "src string, dst string, weight double"))
        if found.limit(FOUND + 1).count() <= FOUND:  # so many rows are broadcast, and the pairs stay where they are
            found = F.broadcast(found)
        return pairs.join(found, ["src", "dst"])


@dataclass
class DualWeights:
    """EASE weights where users are fewer than items: B_ij = x_i^T K^-1 x_j / (1 - x_j^T K^-1 x_j), B_jj = 0, with
    K = X X^T + lambda I. ``inner`` has K^-1 by users, ``cells`` (item number as user_id, user as item_id, weight) is X.
    Dense blocks of ``tile`` columns of B are made in rounds where they are read (``_run_past_dual``): all of B never
    lies in the folder unless ``tiles`` asks for it. ``items`` as for ``Weights``."""
    items: DataFrame
    inner: Weights
    cells: DataFrame
    n: int
    tile: int
    _tiles: DataFrame | None = None

    table = Weights.table
    at = Weights.at

    @property
    def tiles(self) -> DataFrame:
        """(i, j, a): all of B as dense tiles, written once."""
        if self._tiles is None:
            n, tile = self.n, self.tile

            def cut(m, lo, given):
                for i in range(math.ceil(n / tile)):
                    yield _tile_row(i, lo // tile, np.ascontiguousarray(m[i * tile : (i + 1) * tile]))

            self._tiles = _run_past_dual(None, self, None, cut, _TILE, None, 1 << 16)
        return self._tiles


def ease_fit(train: DataFrame, l2: float | None = None, max_items: int | None = None, block: int | None = None) -> Weights | DualWeights:
    """C-7: the EASE weights of all active items (``block``: side of a tile)."""
    from rankfold.operators.ranking import global_rank
    spark = train.sparkSession
    ship_package(spark)
    l2 = DEFAULTS.ease_lambda if l2 is None else l2
    act = active_items(train, max_items)
    idx = materialize(global_rank(act.select(I), [F.asc(I)], "idx").select(I, (F.col("idx") - 1).alias("idx")))
    n = idx.count()
    tile = block or TILE
    if n == 0:
        empty = spark.createDataFrame([], _TILE)
        return Weights(idx.withColumn("scale", F.lit(None).cast("double")), empty, 0, tile)
    if n > DUAL_FROM and l2 > 0 and block is None:
        cells = (train.select(U, I, F.col("weight").cast("double").alias("weight")).join(idx, I)
                      .where(F.col(U).isNotNull() & F.col("weight").isNotNull()))
        users = cells.select(U).distinct().count()
        if 0 < users <= DUAL_SHARE * n:
            most = cells.groupBy(I).agg(F.sum(F.col("weight") ** 2).alias("g")).agg(F.max("g")).first()[0]
            if most <= DUAL_RATIO * l2:
                return _dual_fit(cells, idx, n, users, l2, tile)
    g = gram(train, act, l2=l2, mirror=False)  # item i is not after item j, so row j is not before row i
    # the index grows with the catalog: the planner broadcasts it only while it is small
    cells = (g.join(idx.withColumnRenamed(I, "i").withColumnRenamed("idx", "c"), "i")
              .join(idx.withColumnRenamed(I, "j").withColumnRenamed("idx", "r"), "j").select("r", "c", "g"))
    at = inverse_tiles(gram_tiles(cells, n, tile), n, tile, 1 if block else step_tiles(n, tile))
    return weights_of(spark, idx, at, n, tile)


def _dual_fit(cells: DataFrame, idx: DataFrame, n: int, users: int, l2: float, tile: int) -> DualWeights:
    """The weights by K = X X^T + l2 over users: K^-1 as tiles, and 1 / P_jj of every item from them."""
    from rankfold.operators.ranking import global_rank
    spark = cells.sparkSession
    turned = stored(cells.select(F.lpad(F.col("idx").cast("string"), 12, "0").alias(U), F.col(U).alias(I), "weight"), "cells")  # items as users
    ui = materialize(global_rank(turned.select(I).distinct(), [F.asc(I)], "idx").select(I, (F.col("idx") - 1).alias("idx")))
    k = gram(turned, l2=l2, mirror=False)
    entries = (k.join(ui.withColumnRenamed(I, "i").withColumnRenamed("idx", "c"), "i")
                .join(ui.withColumnRenamed(I, "j").withColumnRenamed("idx", "r"), "j").select("r", "c", "g"))
    at = inverse_tiles(gram_tiles(entries, users, tile), users, tile, step_tiles(users, tile))
    B = DualWeights(idx, _Inverse(ui, spark.read.parquet(at), users, tile), turned, n, max(1, min(tile, DUAL_BYTES // (8 * (n + users)))))
    with batch_bytes(spark, BATCH_BYTES), shuffles_removed(spark):
        q = materialize(_squares(B))
    B.items = materialize(idx.join(q, "idx", "left").select(I, "idx", (F.lit(float(l2)) / (1 - F.coalesce("q", F.lit(0.0)))).alias("scale")))
    worst = B.items.agg(F.min("scale"), F.max(F.isnan("scale") | (F.col("scale") == float("inf")))).first()
    if worst[1] or not worst[0] > 0:
        raise RuntimeError("the inverse is not positive on the diagonal; raise the ridge")
    return B


def _squares(B: DualWeights) -> DataFrame:
    """(idx, q): x_j^T K^-1 x_j of every item j that has entries. Tile (a, b) of K^-1 meets X of its users, and the pairs of
    entries of the same item pick their numbers from it."""
    n, m, tile, inner = B.n, B.inner.n, B.inner.tile, B.inner
    x = B.cells.join(inner.items.select(I, "idx"), I).select(
        F.floor(F.col("idx") / tile).cast("int").alias("b"), F.col(U).cast("int").alias("c"), (F.col("idx") % tile).cast("int").alias("r"),
        F.col("weight").alias("w"), (F.col(U).cast("int") % SPLIT).alias("p"))
    packed = stored(x.groupBy("b", "p").agg(F.sort_array(F.collect_list(F.struct("c", "r", "w"))).alias("x")).select(
        "b", *[F.col("x")[k].alias(k) for k in ("c", "r", "w")]), "entries")  # at most a block's users x (items / SPLIT) a row
    none = [F.lit(None).cast(t).alias(k) for k, t in (("c", "array<int>"), ("r", "array<int>"), ("w", "array<double>"))]
    row = F.col("b").alias("i")
    rows = inner.tiles.select("i", "j", F.lit(1).alias("kind"), "a", *none)
    rows = rows.unionByName(packed.select(row, F.lit(-1).alias("j"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("a"), "c", "r", "w"))
    blocks = math.ceil(m / tile)
    rows = rows.unionByName(packed.withColumn("i", F.explode(F.sequence("b", F.lit(blocks - 1)))).select(
        "i", F.col("b").alias("j"), F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("a"), "c", "r", "w"))

    def run(batches):
        now, own, k, q = None, [], None, np.zeros(n)
        for batch in batches:
            for t in range(batch.num_rows):
                i, j, kind = (batch.column(c)[t].as_py() for c in ("i", "j", "kind"))
                if i != now:
                    now, own = i, []
                if kind == 1:
                    k = -_dense(batch.column("a")[t].as_py(), _side(i, m, tile), _side(j, m, tile))
                    continue
                c, r, w = (batch.column(x)[t].values.to_numpy() for x in ("c", "r", "w"))
                if kind == 0:
                    own.append(tuple(np.array(x) for x in (c, r, w)))
                    continue
                for oc, orow, ow in own:  # sorted by item, as c is
                    if oc[0] % SPLIT != c[0] % SPLIT:
                        continue
                    lo, count = np.searchsorted(oc, c), np.searchsorted(oc, c, "right") - np.searchsorted(oc, c)
                    for first, last, a, z in _blocks_of(c, np.cumsum(count), 1 << 18):
                        each = count[first:last]
                        of = np.repeat(np.arange(first, last), each)
                        at = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + lo[of]
                        q += np.bincount(c[of], k[orow[at], r[of]] * ow[at] * w[of] * (1 if i == j else 2), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(q)), pa.array(q[q != 0])], names=["idx", "q"])

    dealt = rows.repartitionById(blocks, F.col("i")).sortWithinPartitions("i", "j", "kind")
    return dealt.mapInArrow(run, "idx long, q double").groupBy("idx").agg(F.sum("q").alias("q"))


@dataclass
class _Inverse(Weights):
    """A symmetric matrix; ``tiles`` are those of its lower triangle, with the sign turned, as ``inverse_tiles`` gives them."""

    def columns(self, lo: int, hi: int) -> DataFrame:
        n, tile = self.n, self.tile

        def run(batches):
            for batch in batches:
                for t in range(batch.num_rows):
                    i, j, a = (batch.column(c)[t].as_py() for c in ("i", "j", "a"))
                    m = -_dense(a, _side(i, n, tile), _side(j, n, tile))
                    if lo <= j <= hi:
                        yield _tile_row(i, j, m)
                    if i != j and lo <= i <= hi:
                        yield _tile_row(j, i, np.ascontiguousarray(m.T))
        return self.tiles.where(F.col("i").between(lo, hi) | F.col("j").between(lo, hi)).select("i", "j", "a").mapInArrow(run, _TILE)


def weights_of(spark: SparkSession, idx: DataFrame, at: str, n: int, tile: int) -> Weights:
    """B from the tiles of -P at ``at``: both triangles, columns divided by P_jj."""
    def diagonal(batches):
        for batch in batches:
            for t in range(batch.num_rows):
                j, a = batch.column("j")[t].as_py(), batch.column("a")[t].as_py()
                w = _side(j, n, tile)
                pjj = -np.diagonal(_dense(a, w, w))
                if not (np.isfinite(pjj).all() and (pjj > 0).all()):
                    raise RuntimeError(f"the inverse is not positive on the diagonal of tile {j}; raise the ridge")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(w) + j * tile), pa.array(1.0 / pjj)], names=["idx", "scale"])

    def divided(batches):
        for batch in batches:
            for t in range(batch.num_rows):
                i, j, a, flip, scale = (batch.column(c)[t].as_py() for c in ("i", "j", "a", "flip", "scale"))
                h, w = _side(i, n, tile), _side(j, n, tile)
                m = (_dense(a, w, h).T if flip else _dense(a, h, w)) * np.array(scale)[None, :]
                if i == j:
                    np.fill_diagonal(m, 0.0)
                yield _tile_row(i, j, np.ascontiguousarray(m))

    with batch_bytes(spark, BATCH_BYTES):
        lower = spark.read.parquet(at)
        scale = materialize(lower.where("i = j").select("j", "a").mapInArrow(diagonal, "idx long, scale double"))
        per_tile = scale.groupBy(F.floor(F.col("idx") / tile).cast("int").alias("j")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "scale"))), lambda x: x["scale"]).alias("scale"))  # a tile's side each
        both = lower.select("i", "j", "a", F.lit(False).alias("flip")).unionByName(
            lower.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "a", F.lit(True).alias("flip")))
        # n numbers in all, in as many rows as there are tile columns: the planner may broadcast them, or deal the tiles by column
        tiles = both.join(per_tile, "j").select("i", "j", "a", "flip", "scale").mapInArrow(divided, _TILE)
        b_path = _store(tiles, "ease-B")
        remove_path(spark, at)
        items = materialize(idx.join(scale, "idx").select(I, "idx", "scale"))
    return Weights(items, spark.read.parquet(b_path), n, tile)


def times(B: Weights, v: DataFrame) -> DataFrame:
    """(item_id, value) = B v for ``v`` (item_id, value): a tile meets the part of v at its columns."""
    n, tile = B.n, B.tile
    if isinstance(B, DualWeights):
        def product(m, lo, given):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(m @ np.nan_to_num(given))], names=["idx", "part"])

        parts = _run_past_dual(None, B, None, product, "idx long, part double", v, 1 << 16).groupBy("idx").agg(F.sum("part").alias("value"))
        return parts.join(B.items.select(I, "idx"), "idx").select(I, "value")
    parts = B.items.join(v, I).groupBy(F.floor(F.col("idx") / tile).cast("int").alias("j")).agg(
        F.collect_list(F.col("idx")).alias("at"), F.collect_list(F.col("value").cast("double")).alias("v"))  # a tile's side each

    def run(batches):
        for batch in batches:
            for t in range(batch.num_rows):
                i, j, a = (batch.column(c)[t].as_py() for c in ("i", "j", "a"))
                x = np.zeros(_side(j, n, tile))
                x[batch.column("at")[t].values.to_numpy() - j * tile] = batch.column("v")[t].values.to_numpy()
                y = _dense(a, _side(i, n, tile), len(x)) @ x
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(y)) + i * tile), pa.array(y)], names=["idx", "part"])

    with batch_bytes(v.sparkSession, BATCH_BYTES):
        parts = materialize(B.tiles.join(parts, "j").select("i", "j", "a", "at", "v").mapInArrow(run, "idx long, part double").groupBy("idx").agg(
            F.sum("part").alias("value")))
    return parts.join(B.items.select(I, "idx"), "idx").select(I, "value")


def score_ease(hist: DataFrame, B: Weights) -> DataFrame:
    """R-1: raw score per (user, active item) = sum_i w(u,i) * B(i, j)."""
    h = hist.select(U, F.col(I).alias("src"), F.col("weight").cast("double").alias("w"))
    j = h.join(B.table(), "src")
    return j.groupBy(U, F.col("dst").alias(I)).agg(F.sum(F.col("w") * F.col("weight")).alias("raw"))


_PACKED = "kind int, key long, users array<string>, ends array<int>, r array<int>, w array<double>"


def user_slices(hist: DataFrame, B: Weights, entries: int = 1 << 16) -> DataFrame:
    """Histories over active items, about ``entries`` rows packed into one row
    each: users, ends of their entries, item numbers, weights."""
    h = hist.select(U, F.col("weight").cast("double").alias("w"), I).join(B.items.select(I, "idx"), I).select(
        U, F.col("idx").cast("int").alias("r"), "w")
    h = materialize(h)
    slices = max(1, math.ceil(h.count() / entries))
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("users", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())),
                        ("r", pa.list_(pa.int32())), ("w", pa.list_(pa.float64()))])

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(U, "ascending"), ("r", "ascending")])
        users = rows.column(U).combine_chunks().dictionary_encode()
        ends = np.flatnonzero(np.diff(users.indices.to_numpy(), append=-1)) + 1
        return pa.table({"kind": [2], "key": [rows.column("slice")[0].as_py()], "users": [users.dictionary.to_pylist()], "ends": [ends],
                         "r": [rows.column("r").to_numpy()], "w": [rows.column("w").to_numpy()]}, schema=schema)

    return h.withColumn("slice", F.pmod(F.xxhash64(U), F.lit(slices))).groupBy("slice").applyInArrow(pack, _PACKED)


def _shaped(df: DataFrame) -> DataFrame:
    kinds = {"cell": "int", "kind": "int", "i": "int", "lo": "int", "a": "binary", "key": "long", "users": "array<string>", "ends": "array<int>",
             "r": "array<int>", "w": "array<double>"}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def _run_past(hist: DataFrame, B: Weights, finish, schema: str, columns: DataFrame | None, block: int, slice_entries: int, task_bytes: int,
              at: str | None = None) -> DataFrame:
    """What ``finish(users, ends, r, w, m, lo, given)`` yields for every slice of
    users and every dense column block ``m`` of B, written once.

    The columns of B are cut into blocks of at most ``block`` and ``task_bytes``,
    one partition each, in up to ``PARTS`` jobs. B's tiles are sent once, each to the blocks of its
    columns; packed slices of users follow in the same partition and run past
    the dense block, so a task holds one block and one slice. ``columns``
    (item_id, value) reaches ``finish`` as the block's part, nan where it has no row.
    The rows go to ``at``, or to a path of their own.
    """
    if isinstance(B, DualWeights):
        return _run_past_dual(hist, B, finish, None, schema, columns, slice_entries)
    spark = hist.sparkSession
    ship_package(spark)
    n, tile = B.n, B.tile
    width = max(1, min(block, task_bytes // (8 * n)))
    blocks = math.ceil(n / width)
    parts = max(1, min(PARTS, 8 * n * n // PART_BYTES))
    share = math.ceil(blocks / parts)
    packed = user_slices(hist, B, slice_entries)
    if parts > 1:
        packed = stored(packed, "users")
    cut = pa.schema([("cell", pa.int32()), ("kind", pa.int32()), ("i", pa.int32()), ("lo", pa.int32()), ("a", pa.binary())])

    def cells(start, end):  # the columns of a tile by block
        def run(batches):
            for batch in batches:
                for t in range(batch.num_rows):
                    i, j, a = (batch.column(c)[t].as_py() for c in ("i", "j", "a"))
                    w = _side(j, n, tile)
                    m = _dense(a, _side(i, n, tile), w)
                    for cell in range(max(start, j * tile // width), min(end - 1, (j * tile + w - 1) // width) + 1):
                        x, z = max(j * tile, cell * width), min(j * tile + w, (cell + 1) * width)
                        part = np.ascontiguousarray(m[:, x - j * tile : z - j * tile]).tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((cell, 1, i, x, part), cut, strict=True)], schema=cut)
        return run

    of = None
    if columns is not None:  # comes first
        of = B.items.join(columns, I).groupBy(F.floor(F.col("idx") / width).alias("cell")).agg(
            F.collect_list("idx").alias("r"), F.collect_list(F.col("value").cast("double")).alias("w"))  # a block's columns each

    def run(batches):
        now, m, given = None, None, None
        for batch in batches:
            for t in range(batch.num_rows):
                cell, kind = batch.column("cell")[t].as_py(), batch.column("kind")[t].as_py()
                lo = cell * width
                if cell != now:
                    now, m = cell, np.zeros((n, min(width, n - lo)))
                    given = np.full(m.shape[1], np.nan)
                if kind == 1:
                    i, x = batch.column("i")[t].as_py(), batch.column("lo")[t].as_py()
                    part = _dense(batch.column("a")[t].as_py(), _side(i, n, tile), -1)
                    m[i * tile : i * tile + len(part), x - lo : x - lo + part.shape[1]] = part
                    continue
                r, w = batch.column("r")[t].values.to_numpy(), batch.column("w")[t].values.to_numpy()
                if kind == 0:
                    given[r - lo] = w
                else:
                    yield from finish(batch.column("users")[t].values, batch.column("ends")[t].values.to_numpy(), r, w, m, lo, given)

    at = at or scratch_path(spark, "past")
    with batch_bytes(spark, BATCH_BYTES), shuffles_removed(spark):
        for start in range(0, blocks, share):
            end = min(blocks, start + share)
            rows = _shaped(B.columns(start * width // tile, (end * width - 1) // tile).mapInArrow(
                cells(start, end), "cell int, kind int, i int, lo int, a binary"))
            rows = rows.unionByName(_shaped(packed.withColumn("cell", F.explode(F.sequence(F.lit(start), F.lit(end - 1))))))
            if of is not None:
                rows = rows.unionByName(_shaped(of.where(F.col("cell").between(start, end - 1)).withColumn("kind", F.lit(0))))
            dealt = rows.repartitionById(end - start, (F.col("cell") - start).cast("int"))
            dealt.sortWithinPartitions("cell", "kind", "key").mapInArrow(run, schema).write.mode("append").option("compression", "none").parquet(at)
    return spark.read.schema(schema).parquet(at)


def _run_past_dual(hist: DataFrame | None, B: DualWeights, finish, ended, schema: str, columns: DataFrame | None, slice_entries: int) -> DataFrame:
    """``_run_past`` for ``DualWeights``; ``ended(m, lo, given)`` is called for every finished column block.

    A round takes some column blocks J: K^-1 X_J is made past the blocks of K^-1 and written (half the bytes of K^-1, or
    ``ROUND_BYTES``), then sent to its column blocks, where the packed items make X^T K^-1 X_J, so B's columns, and the packed users
    run past them. A task holds the block of K^-1 X and the one of B."""
    spark = B.items.sparkSession
    ship_package(spark)
    n, m, width, inner = B.n, B.inner.n, B.tile, B.inner
    blocks, cores = math.ceil(n / width), spark.sparkContext.defaultParallelism
    share = max(ROUND_BYTES, 4 * m * m) // (8 * m * width)
    share = max(1, share // cores * cores if share > cores else share)
    items = stored(user_slices(B.cells, inner, slice_entries), "items")
    users = None if hist is None else stored(user_slices(hist, B, slice_entries), "users")
    cut = pa.schema([("cell", pa.int32()), ("i", pa.int32()), ("r", pa.list_(pa.int32())), ("a", pa.binary())])

    def rows_of(names, ends, r, w, k, lo, given):  # (items of the slice) x (users of the block) of X^T K^-1, by column block of B
        number = names.cast(pa.int64()).to_numpy()
        for first, last, a, z in _blocks_of(names, ends, DUAL_ENTRIES):
            got = np.add.reduceat(k[r[a[0] : z[-1]]] * w[a[0] : z[-1], None], a - a[0], axis=0)
            cell = number[first:last] // width
            edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                    (cell[x], lo, number[first + x : first + y], got[x:y].tobytes()), cut, strict=True)], schema=cut)

    def run(batches):
        now, k, b, given, whole = None, None, None, None, False

        def close():  # B's columns, once all items have come
            own = np.arange(b.shape[1])
            b[:] /= 1 - b[now * width + own, own]
            b[now * width + own, own] = 0.0

        for batch in batches:
            for t in range(batch.num_rows):
                cell, kind = batch.column("cell")[t].as_py(), batch.column("kind")[t].as_py()
                lo = cell * width
                if cell != now:
                    if now is not None:
                        if not whole:
                            close()
                        if ended is not None:
                            yield from ended(b, now * width, given)
                    now, k, b, whole = cell, np.zeros((m, min(width, n - lo))), np.zeros((n, min(width, n - lo))), False
                    given = np.full(b.shape[1], np.nan)
                if kind == -1:  # comes first, so that blocks without entries are there too
                    continue
                r = batch.column("r")[t].values.to_numpy()
                if kind == 1:
                    part = _dense(batch.column("a")[t].as_py(), len(r), -1)
                    x = batch.column("i")[t].as_py()
                    k[x : x + part.shape[1], r - lo] = part.T
                    continue
                w = batch.column("w")[t].values.to_numpy()
                if kind == 0:
                    given[r - lo] = w
                    continue
                names, ends = batch.column("users")[t].values, batch.column("ends")[t].values.to_numpy()
                if kind == 2:
                    number = names.cast(pa.int64()).to_numpy()
                    for first, last, a, z in _blocks_of(names, ends, DUAL_ENTRIES):
                        b[number[first:last]] = np.add.reduceat(k[r[a[0] : z[-1]]] * w[a[0] : z[-1], None], a - a[0], axis=0)
                    continue
                if not whole:
                    close()
                    whole = True
                yield from finish(names, ends, r, w, b, lo, given)
        if now is not None:
            if not whole:
                close()
            if ended is not None:
                yield from ended(b, now * width, given)

    out = scratch_path(spark, "past")
    with batch_bytes(spark, BATCH_BYTES), shuffles_removed(spark):
        for start in range(0, blocks, share):
            end = min(blocks, start + share)
            mine = F.col(U).cast("long").between(start * width, end * width - 1)
            at = scratch_path(spark, "round")
            _run_past(B.cells.where(mine), inner, rows_of, "cell int, i int, r array<int>, a binary", None, 512, slice_entries, DUAL_BYTES // 2, at)
            step = cores if 8 * m * n > PART_BYTES else end - start  # one block a core
            for lo in range(start, end, step):
                hi = min(end, lo + step)
                each, here = F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))), F.col("cell").between(lo, hi - 1)
                rows = _shaped(spark.range(lo, hi).select(F.col("id").alias("cell"), F.lit(-1).alias("kind")))
                rows = rows.unionByName(_shaped(spark.read.parquet(at).where(here).withColumn("kind", F.lit(1))))
                rows = rows.unionByName(_shaped(items.withColumn("cell", each)))
                if users is not None:
                    rows = rows.unionByName(_shaped(users.withColumn("cell", each).withColumn("kind", F.lit(3))))
                if columns is not None:
                    of = B.items.join(columns, I).groupBy(F.floor(F.col("idx") / width).alias("cell")).agg(
                        F.collect_list("idx").alias("r"), F.collect_list(F.col("value").cast("double")).alias("w"))  # a block's columns each
                    rows = rows.unionByName(_shaped(of.where(here).withColumn("kind", F.lit(0))))
                dealt = rows.repartitionById(hi - lo, (F.col("cell") - lo).cast("int")).sortWithinPartitions("cell", "kind", "key")
                done = dealt.mapInArrow(run, schema)
                write_tiles(done, out, "append") if schema == _TILE else done.write.mode("append").option("compression", "none").parquet(out)
            remove_path(spark, at)
    return spark.read.schema(schema).parquet(out)


def score_ease_topk(hist: DataFrame, B: Weights, k: int, allowed: DataFrame | None = None, block: int = 512,
                    slice_entries: int = 1 << 16, task_bytes: int = 64 << 20) -> DataFrame:
    """R-1 + J-4 + W-4 at scale: per user the k best unseen active items by EASE
    score. Users' own items, and items outside ``allowed`` (item_id), are masked
    inside the column block, and only the best k of a block leave it. Output
    (user_id, item_id, raw)."""
    spark = hist.sparkSession
    if B.n == 0:
        return spark.createDataFrame([], f"{U} string, {I} string, raw double")
    schema, masked = pa.schema([(U, pa.string()), ("c", pa.int64()), ("raw", pa.float64())]), allowed is not None

    def best(users, ends, r, w, m, lo, given):
        shut = np.isnan(given) if masked else None
        yield from _best_of(users, ends, r, w, m, shut, lo, k, schema)

    only = None if allowed is None else allowed.select(I).distinct().withColumn("value", F.lit(1.0))
    cand = _run_past(hist, B, best, f"{U} string, c long, raw double", only, block, slice_entries, task_bytes)
    named = cand.join(B.items.select(F.col("idx").alias("c"), I), "c")
    w = Window.partitionBy(U).orderBy(F.desc("raw"), F.asc(I))
    return named.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).select(U, I, "raw")


def project_scores(hist: DataFrame, B: Weights, y: DataFrame, block: int = 512, slice_entries: int = 1 << 16, task_bytes: int = 64 << 20) -> DataFrame:
    """(user_id, value): sum_j score(u, j) y(j) over all active items j, for
    ``y`` (item_id, value): a linear functional of every score of a user."""
    schema = pa.schema([(U, pa.string()), ("part", pa.float64())])

    def summed(users, ends, r, w, m, lo, given):
        along = (m @ np.nan_to_num(given))[r] * w
        starts = np.concatenate([[0], ends[:-1]])
        yield pa.RecordBatch.from_arrays([users, pa.array(np.add.reduceat(along, starts))], schema=schema)

    parts = _run_past(hist, B, summed, f"{U} string, part double", y, block, slice_entries, task_bytes)
    return parts.groupBy(U).agg(F.sum("part").alias("value"))


def _blocks_of(users, ends, entries: int = 4096):
    """Runs of users with about ``entries`` entries."""
    starts, first = np.concatenate([[0], ends[:-1]]), 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + entries, "right")))
        yield first, last, starts[first:last], ends[first:last]
        first = last


def _best_of(users, ends, r, w, m, shut, lo, k, schema):
    """The best ``k`` columns of block ``m`` for each user of a slice."""
    kept = min(k, m.shape[1])
    for first, last, a, z in _blocks_of(users, ends):
        mine, ww = r[a[0] : z[-1]], w[a[0] : z[-1]]
        score = np.add.reduceat(m[mine] * ww[:, None], a - a[0], axis=0)
        row = np.repeat(np.arange(last - first), z - a)
        own = (mine >= lo) & (mine < lo + m.shape[1])
        score[row[own], mine[own] - lo] = -np.inf
        if shut is not None:
            score[:, shut] = -np.inf
        edge = np.partition(score, m.shape[1] - kept, axis=1)[:, m.shape[1] - kept, None]
        over, tied = score > edge, score == edge  # ties at the edge go by number, as in the list
        over |= tied & (tied.cumsum(1) <= kept - over.sum(1, keepdims=True))
        at, col = np.nonzero(over & np.isfinite(score))
        yield pa.RecordBatch.from_arrays([users.take(pa.array(at + first)), pa.array(col + lo, pa.int64()), pa.array(score[at, col])], schema=schema)
