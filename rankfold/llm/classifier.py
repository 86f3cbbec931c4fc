"""Document quality: logistic regression on hashed word n-grams, trained by
follow-the-regularised-leader, scored as sparse dot products.

A text's tokens are runs of letters and digits and runs of other visible
characters. Features are hashed into 2^BITS dimensions: token unigrams and
bigrams, unigrams and bigrams of token shapes (case, digits, length class;
signs as they are), and a mark for each bigram that the text had before. A
feature's value is its count over the text's number of tokens, so texts of any
length are on one scale.

Training reads a bounded, documented sample of labelled rows (MAX_TRAIN, taken
in the order of a hash of the id); scoring reads every whole text. Labels,
languages, sources and ids are no features.

Defined cases: null, empty and blank texts have only the bias; a null label is
no label; of several labels of one id the training uses each; repeated rows are
scored each; with no labels, or none of one class, the model is the prior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.llm.text import add_column, buffers, first_by_hash, mix, prepare, rows_of, slices, word_hashes

BITS = 18
#: Labelled rows that the fit reads at most.
MAX_TRAIN = 6000

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.where(_BLANK, 0, np.where(_LETTER, 1, 2)).astype(np.int8)
_SHOWN = ~_BLANK  # blanks after a token are no part of its hash


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Byte starts, ends, rows and kinds (1 letters or digits, 2 signs) of all tokens."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.int8)
    kind = _KIND[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    kinds = kind[starts]
    keep = kinds > 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, kinds[keep]


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all rows: owner rows (sorted by kind of feature, then
    row), indices below 2^BITS, and tokens by row. One entry per occurrence."""
    data, offsets = buffers(column)
    starts, ends, rows, kinds = tokens(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, count
    words = word_hashes(data, starts, ends, _SHOWN, fold=True)
    upper = np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int32), starts) if len(starts) else starts
    digit = np.add.reduceat(((data >= 48) & (data <= 57)).astype(np.int32), starts)
    size = ends - starts
    # reduceat runs to the next token; only blanks lie between, which count as nothing
    case = np.where(upper == 0, 0, np.where(upper == size, 2, 1)) + 3 * (digit > 0)
    shape = (case * 8 + np.minimum(size, 28) // 4).astype(np.uint64)
    shape = np.where(kinds == 2, words, shape)
    pair = rows[1:] == rows[:-1]
    seed = lambda k: np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    two = mix(words[:-1] * np.uint64(3) + words[1:] + seed(2))[pair]
    shapes = mix(mix(shape[:-1] + seed(4)) + shape[1:])[pair]
    owner2 = rows[:-1][pair]
    order = np.lexsort((two, owner2))
    again = np.zeros(len(order), bool)
    again[1:] = (two[order][1:] == two[order][:-1]) & (owner2[order][1:] == owner2[order][:-1])
    owner = np.concatenate([rows, owner2, rows, owner2, owner2[order][again]])
    index = np.concatenate([mix(words + seed(1)), two, mix(shape + seed(3)), shapes,
                            np.full(again.sum(), mix(np.array([seed(5)]))[0])])
    return owner, (index & np.uint64((1 << BITS) - 1)).astype(np.int64), count


@dataclass
class Model:
    """Weights of the hashed features; the only non-zero ones, and a bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.index] = self.weight
        return out

    def scores(self, column) -> np.ndarray:
        """Probability of label 1 for each row: a sparse dot product, scaled by the row's tokens."""
        owner, index, count = features(column)
        dot = np.bincount(owner, self.dense()[index], minlength=len(count))
        return 1 / (1 + np.exp(-np.clip(self.bias + dot / np.maximum(count, 1), -30, 30)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, alpha: float = 1.0, beta: float = 1.0,
        l1: float = 0.0002, l2: float = 0.001, balance: bool = True) -> Model:
    """FTRL-proximal over (indices, values, label) examples, in their order.
    Classes weigh alike, so the rarer one is not drowned."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0
    ones = sum(y for _, _, y in examples)
    if not 0 < ones < len(examples):
        p = (ones + 1) / (len(examples) + 2)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))
    scale = (len(examples) / (2 * (len(examples) - ones)), len(examples) / (2 * ones)) if balance else (1.0, 1.0)
    rng = np.random.default_rng(7)

    def at(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            index, value, y = examples[k]
            w = at(z[index], n[index])
            b = -z0 / ((beta + np.sqrt(n0)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(b + w @ value, -30, 30)))
            g = (p - y) * scale[y] * value
            g0 = (p - y) * scale[y]
            s = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - s * w
            n[index] += g * g
            z0 += g0 - (np.sqrt(n0 + g0 * g0) - np.sqrt(n0)) / alpha * b
            n0 += g0 * g0
    w = at(z, n)
    index = np.flatnonzero(w)
    return Model(index, w[index], float(-z0 / ((beta + np.sqrt(n0)) / alpha)))


def _examples(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            owner, index, count = features(part.column("text"))
            made = []
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
            for row in range(part.num_rows):
                i, c = np.unique(index[order[cuts[row] : cuts[row + 1]]], return_counts=True)
                made.append((i.astype(np.int32).tobytes(), (c / max(1, count[row])).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([
                part.column("y"), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())],
                names=["y", "index", "value"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text",
          most: int = MAX_TRAIN) -> Model:
    """Fits on at most ``most`` labelled rows. Texts become sparse features in
    the tasks. An id with several document rows gives one example, that with the
    smallest features, and a label given n times counts n times: the driver gets
    at most ``most`` examples however often an id is repeated."""
    prepare(docs.sparkSession)
    sample = rows_of(labels, id_col, label).toDF("id", "y").where("id is not null and y is not null").withColumn(
        "y", F.col("y").cast("int")).withColumn("turn", F.xxhash64(F.col("id"), F.lit(11)))
    sample = first_by_hash(sample, "turn", most).drop("turn")
    # the sample is bounded by ``most`` rows of three numbers
    sample = sample.groupBy("id", "y").agg(F.count(F.lit(1)).alias("n"))
    joined = rows_of(docs, id_col, text).toDF("id", "text").join(F.broadcast(sample), "id")
    made = joined.select("id", "y", "n", "text").mapInArrow(_with_id(_examples), "id string, n long, y int, index binary, value binary")
    rows = made.groupBy("id", "y", "n").agg(F.min(F.struct("index", "value")).alias("x")).collect()
    rows.sort(key=lambda r: (r["id"], r["x"]["index"], r["y"]))
    return fit([(np.frombuffer(r["x"]["index"], np.int32).astype(np.int64), np.frombuffer(r["x"]["value"], np.float32).astype(float), r["y"])
                for r in rows for _ in range(r["n"])])


def _with_id(make):
    """The features with the id and the label's count before them, for a stable order of the updates."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, times = part.column("id").cast(pa.string()), part.column("n")
                for made in make([part]):
                    yield pa.RecordBatch.from_arrays([ids, times, *made.columns], names=["id", "n", *made.schema.names])
    return run


def add_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1. The weights are broadcast; their size is at most 2^BITS numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_column(docs, out, T.DoubleType(), text, lambda part: pa.array(shared.value.scores(part.column(text))))
