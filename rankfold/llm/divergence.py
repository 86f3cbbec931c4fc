"""Source divergence audit: how far the sources of a language are apart, and by which terms.

Every (language, source) group and every language has a smoothed share of each
kept term, in whole billionths; all arithmetic is on whole numbers.

1. Counts. Tasks count the terms of some megabytes of text at a time, Spark
   merges them with partial sums. A hot source or term is one row per task.
   Terms in fewer documents of the language than asked go.
2. Pairs of sources. The terms' counts are dealt to groups of (language, tile of
   sources, tile of sources, salt by term), a bounded number of terms each, and
   summed there into one matrix of the tile; no row is made for a pair of a
   term. Terms that neither source has are alike: they are counted, not visited.
3. Terms of a source, by a dominance skyband. With more in the group, no more
   in the language and an earlier name a term ranks before another, so one that
   k others dominate is not among the first k. Each partition keeps the terms
   that fewer than k of its others dominate; skybands are merged, some at
   a time, by the same rule; what is left is ranked exactly.

Defined cases: null texts, languages and sources are read as ''; every row is a
document, also one that repeats; groups without any kept term have the share of
a count of 0; a language with one source has no pairs; an empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.text import buffers, materialize, prepare, rows_of, slices, table, word_spans

#: Letters, and all beyond ASCII: `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`.
LETTERS = table(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Text bytes that a task counts at a time.
COUNT_BYTES = 16 << 20
#: Sources in a tile, and terms in a group and in one step of it.
TILE, GROUP_TERMS, STEP_TERMS = 128, 1 << 14, 2048
#: Skybands of a group merged at a time, and rows that a partition adds to its skybands at a time.
MERGE, STEP_ROWS = 16, 1 << 18
#: Shares are in units of 1 / UNIT.
UNIT = 1_000_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _count(batch: pa.Table) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some documents."""
    data, offsets = buffers(batch.column("text"))
    starts, ends, docs = word_spans(data, offsets, LETTERS)
    where = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=where[1:])
    body = _LOWER[data[LETTERS[data]]].tobytes()
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(body)).dictionary_encode()
    lang, source = (batch.column(c).combine_chunks() for c in ("lang", "source"))
    codes = [c.dictionary_encode() for c in (lang, source)]
    pair = codes[0].indices.to_numpy().astype(np.int64) * len(codes[1].dictionary) + codes[1].indices.to_numpy()
    row, group = np.unique(pair, return_index=True, return_inverse=True)[1:]  # a document of each group, the group of each document
    term, wide = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    in_doc, n = np.unique(docs * wide + term, return_counts=True)  # once per document and term
    keys, at = np.unique(group[in_doc // wide] * wide + in_doc % wide, return_inverse=True)
    name = pa.array(row[keys // wide])
    columns = [lang.take(name), source.take(name),
               words.dictionary.take(pa.array(keys % wide)).cast(pa.string()), pa.array(np.bincount(at, n, len(keys)).astype(np.int64)),
               pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _counted(batches):
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", COUNT_BYTES):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py()
            if size >= COUNT_BYTES:
                yield _count(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield _count(pa.Table.from_batches(held))


def term_counts(docs: DataFrame, least_docs: int = 3, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Two written tables: (lang, term, n, by: [(source, n)]), the kept terms of
    every language, and (lang, source, total, terms, lang_total), every group."""
    prepare(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), name(lang).alias("lang"), name(source).alias("source"))
    groups = rows.select("lang", "source").distinct()
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    by = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = by.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by"))
    terms = materialize(terms.where(F.col("docs") >= least_docs).drop("docs"))
    totals = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    own = terms.select("lang", F.explode("by").alias("g")).groupBy("lang", F.col("g.source").alias("source")).agg(F.sum("g.n").alias("total"))
    groups = groups.join(own, ["lang", "source"], "left").join(totals, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    return terms, materialize(groups)


def share(count, total, terms) -> F.Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact while total + terms is below 9 * 10^15."""
    of = F.greatest(total + terms, F.lit(1))  # 0 where a language has no kept term: no share is used
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):  # three digits at a time, by hand: 10^9 times a count needs more than 64 bits
        out, rest = out * 1000 + F.call_function("div", rest * 1000, of), (rest * 1000) % of
    return out + 1


def _distance(p, q) -> F.Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    rest, out = count + 1, np.zeros(np.broadcast(count, of).shape, np.int64)
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // of, rest * 1000 % of
    return out + 1


_SUMS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64()), ("seen", pa.int64())])


def _tile_sums(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of the distances over the terms of one group of cells, for each pair
    (a, b), a of the first tile and b of the second."""
    if not cells.num_rows:
        return _SUMS.empty_table()
    groups = groups.sort_by([("side", "ascending"), ("number", "ascending")])
    number, ofs, side = (groups.column(c).to_numpy() for c in ("number", "of", "side"))
    ka, kb = number[side == 0], number[side == 1]
    term = cells.column("term").combine_chunks().dictionary_encode()
    seen = len(term.dictionary)
    code, n, second = term.indices.to_numpy(), cells.column("n").to_numpy(), cells.column("side").to_numpy() == 1
    col = cells.column("number").to_numpy()
    col = np.where(second, np.searchsorted(kb, col) + len(ka), np.searchsorted(ka, col))
    order = np.argsort(code, kind="stable")
    code, n, col = code[order], n[order], col[order]
    total = np.zeros((len(ka), len(kb)), np.int64)
    for lo in range(0, seen, STEP_TERMS):
        x, z = np.searchsorted(code, [lo, lo + STEP_TERMS])
        counts = np.zeros((min(STEP_TERMS, seen - lo), len(ofs)), np.int64)
        counts[code[x:z] - lo, col[x:z]] = n[x:z]
        p = _shares(counts, ofs[None, :])
        q = p[:, len(ka):]
        for i in range(len(ka)):
            gap = p[:, i : i + 1] - q
            total[i] += (gap * gap // q).sum(0)
    a, b = np.repeat(ka, len(kb)), np.tile(kb, len(ka))
    return pa.table([pa.array([cells.column("lang")[0].as_py()] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(total.ravel()),
                     pa.array(np.full(len(a), seen))], schema=_SUMS)


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each source from each other source of its language."""
    w = Window.partitionBy("lang").orderBy("source")  # a row per source; the result has a row per pair of them
    numbered = materialize(groups.withColumn("number", (F.row_number().over(w) - 1).cast("long")))
    tile = F.floor(F.col("number") / TILE)
    last = F.floor((F.max("number").over(Window.partitionBy("lang"))) / TILE)
    sized = numbered.withColumn("of", F.col("total") + F.col("terms")).withColumn("tile", tile).withColumn("last", last)
    sized = sized.withColumn("salts", F.ceil(F.col("terms") / GROUP_TERMS))
    # each source is a row of its tile's row of tiles and a column of its tile's column of tiles
    sides = F.explode(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda o: F.array(
        F.struct(F.col("tile").alias("x"), o.alias("y"), F.lit(0).alias("side")), F.struct(o.alias("x"), F.col("tile").alias("y"), F.lit(1).alias("side"))))))
    placed = sized.select("lang", "source", "number", "of", "salts", sides.alias("at")).select("lang", "source", "number", "of", "salts", "at.*")
    cells = terms.select("lang", "term", F.explode("by").alias("g")).select("lang", "term", F.col("g.source").alias("source"), F.col("g.n").alias("n"))
    cells = cells.join(placed, ["lang", "source"]).withColumn("salt", F.pmod(F.xxhash64("term"), F.col("salts")))
    every = placed.where("salts > 0").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    keys = ["lang", "x", "y", "salt"]
    every = every.select(*keys, "number", "side", "of").toDF(*keys, "number", "side", "of")  # own columns, not those of the cells
    sums = cells.select(*keys, "term", "number", "side", "n").groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(
        _tile_sums, "lang string, a long, b long, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = numbered.select("lang", F.col("number").alias("a"), "source", "terms", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("p"))
    two = numbered.select("lang", F.col("number").alias("b"), F.col("source").alias("item"), share(F.lit(0).cast("long"), F.col("total"), F.col("terms")).alias("q"))
    pairs = one.join(two, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    rest = (F.col("terms") - F.coalesce("seen", F.lit(0))) * _distance(F.col("p"), F.col("q"))
    value = F.when(F.col("terms") == 0, F.lit(0)).otherwise(F.coalesce("value", F.lit(0)) + rest)
    return pairs.select("lang", "source", "item", value.cast("long").alias("value"))


def skyband(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others dominate: at least as much
    in ``n``, at most as much in ``lang_n``, and before them in ``term`` (ranks)."""
    order = np.lexsort((term, lang_n, -n))
    # of equal counts, only the first k names can stay
    same = np.ones(len(order), bool)
    same[1:] = (n[order][1:] != n[order][:-1]) | (lang_n[order][1:] != lang_n[order][:-1])
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, np.arange(len(order)), 0))
    order = order[run < k]
    # dominators come earlier in this order, and k of them are in the skyband if k are anywhere
    kept = np.zeros(0, np.int64)
    for lo in range(0, len(order), step):
        some = order[lo : lo + step]
        over = ((lang_n[kept][None, :] <= lang_n[some][:, None]) & (term[kept][None, :] < term[some][:, None])).sum(1)
        some = some[over < k]
        over = over[over < k]
        inside = (lang_n[some][None, :] <= lang_n[some][:, None]) & (term[some][None, :] < term[some][:, None])
        # rows are in order, so a dominator of equal counts or better is before; one dropped here has k others in its place
        inside &= np.tri(len(some), k=-1, dtype=bool)
        kept = np.concatenate([kept, some[over + inside.sum(1) < k]])
    return kept


_CANDIDATE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.int64()), ("term", pa.string()), ("n", pa.int64()),
                        ("lang_n", pa.int64()), ("p", pa.int64()), ("q", pa.int64())])
_KIND = "lang string, source string, part long, term string, n long, lang_n long, p long, q long"


def _skyband_of(rows: pa.Table, k: int) -> pa.Table:
    if rows.num_rows <= k:
        return rows
    term = pc.rank(rows.column("term"), sort_keys="ascending", tiebreaker="first").to_numpy()  # by UTF-8 bytes
    return rows.take(pa.array(skyband(rows.column("n").to_numpy(), rows.column("lang_n").to_numpy(), term, k)))


def _local_skybands(k: int):
    def run(batches):
        held: dict[tuple, pa.Table] = {}  # group -> the skyband of its rows so far

        def merge(rows: pa.Table) -> None:
            rows = rows.combine_chunks().sort_by([("lang", "ascending"), ("source", "ascending")])
            lang, source = rows.column("lang").to_pylist(), rows.column("source").to_pylist()
            edges = [0, *[i for i in range(1, len(lang)) if lang[i] != lang[i - 1] or source[i] != source[i - 1]], len(lang)]
            for lo, hi in itertools.pairwise(edges):
                mine = rows.slice(lo, hi - lo)
                if (at := (lang[lo], source[lo])) in held:
                    mine = pa.concat_tables([held[at], mine])
                held[at] = _skyband_of(mine.combine_chunks(), k)

        some, n = [], 0
        for batch in batches:
            some.append(batch.cast(_CANDIDATE))
            n += batch.num_rows
            if n >= STEP_ROWS:
                merge(pa.Table.from_batches(some))
                some, n = [], 0
        if n:
            merge(pa.Table.from_batches(some))
        for rows in held.values():
            yield from rows.to_batches()
    return run


def source_terms(terms: DataFrame, groups: DataFrame, k: int = 200) -> DataFrame:
    """(lang, source, item, value, rank): the first ``k`` terms that a source has
    more of than its language, by distance and name."""
    cells = terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("by").alias("g")).select(
        "lang", F.col("g.source").alias("source"), F.spark_partition_id().cast("long").alias("part"), "term", F.col("g.n").alias("n"), "lang_n")
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    cells = cells.join(groups, ["lang", "source"]).select("lang", "source", "part", "term", "n", "lang_n", p.alias("p"), q.alias("q"))
    found = cells.where("p > q").mapInArrow(_local_skybands(k), _KIND)
    parts = terms.rdd.getNumPartitions()
    found = materialize(found)
    while parts > 1:
        parts = -(-parts // MERGE)
        found = found.withColumn("part", F.floor(F.col("part") / MERGE) if parts > 1 else F.lit(0).cast("long"))
        found = found.groupBy("lang", "source", "part").applyInArrow(lambda rows: _skyband_of(rows, k), _KIND)
    ranked = found.select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def audit(docs: DataFrame, least_docs: int = 3, k: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, all other sources
    of the language by distance, and part ``term``, the first ``k`` terms."""
    terms, groups = term_counts(docs, least_docs, text, lang, source)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(terms, groups).withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair"))
    first = source_terms(terms, groups, k).withColumn("part", F.lit("term"))
    return rows_of(pairs.unionByName(first), "lang", "source", "part", "item", "value", "rank")


__all__ = ["audit", "share", "skyband", "source_pairs", "source_terms", "term_counts"]
