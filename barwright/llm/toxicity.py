"""Toxicity scores by non-negative positive-unlabelled learning on hashed word and character features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import keep, small_batches
from barwright.llm.tokens import LOWER, PUNCT, SMALL_SLICE, Words, flat, slices

FOLDS = 5
BITS = 19
GRAM = 5
#: The classifier is fitted on at most so many documents known to be toxic, and so many without a label or of unknown
#: one: those whose hashed ids are smallest. All other figures are of all rows.
MOST_POSITIVE = 6_000
MOST_UNLABELLED = 12_000
#: A feature is used if its share among positives exceeds that among unlabelled texts by so many standard errors, and is
#: at least so many times as large.
LEAST_Z, LEAST_RATIO = 4.0, 3.0
EPOCHS = 25
BATCH = 300
RATE = 0.05
DECAY = 1e-4
#: The class prior where no label is known.
PRIOR = 0.1


class Features:
    """Distinct hashed features of each row: its words, and the character 5-grams of each word with its ends marked."""

    def __init__(self, column: pa.Array):
        data, off = flat(column)
        w = Words(LOWER[data], off, PUNCT)
        code, distinct = w.encode()
        self.n = len(column)
        # Distinct (row, word) pairs, then the features of each distinct word.
        pair = np.unique(w.row_of * (len(distinct) + 1) + code) if len(code) else np.zeros(0, np.int64)
        row, word = pair // (len(distinct) + 1), pair % (len(distinct) + 1)
        feats, begin = self._of_words(distinct)
        count = np.diff(begin)[word]
        at = np.repeat(begin[word] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        both = np.sort(np.repeat(row, count) << BITS | feats[at]) if len(at) else np.zeros(0, np.int64)
        both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
        self.row, self.feature = both >> BITS, both & ((1 << BITS) - 1)

    @staticmethod
    def _of_words(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = flat(distinct)
        size = np.diff(off)
        # ^word$ for each, one after another.
        to = np.zeros(len(data) + 2 * len(size), np.uint8)
        begin = off[:-1] + 2 * np.arange(len(size))
        inner = np.ones(len(to), bool)
        inner[begin] = inner[begin + size + 1] = False
        to[inner] = data
        to[begin], to[begin + size + 1] = 1, 2
        width = np.minimum(size + 2, GRAM)
        grams = size + 2 - width + 1
        total = np.concatenate(([0], np.cumsum(grams)))
        at = np.repeat(begin - total[:-1], grams) + np.arange(total[-1])
        value = np.zeros(len(at), np.uint64)
        short = np.repeat(width, grams)
        for j in range(GRAM):
            byte = to[np.minimum(at + j, len(to) - 1)].astype(np.uint64) if len(to) else np.zeros(0, np.uint64)
            value = value << np.uint64(8) | np.where(j < short, byte, 0)
        grams = value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
        whole = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) >> 64 - BITS for w in distinct), np.uint64, len(distinct))
        return np.insert(grams, total[1:], whole).astype(np.int64), total + np.arange(len(total))

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.row, weights[self.feature], self.n)


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    prior: float


class Shares:
    """In how many positives and how many unlabelled texts each feature is found; equal texts count once."""

    def __init__(self):
        self.counts = np.zeros((2, 1 << BITS), np.int32)
        self.seen: tuple[set, set] = (set(), set())

    def add(self, toxic: int, features: np.ndarray) -> None:
        name = xxhash.xxh64_intdigest(features.tobytes())
        if name not in self.seen[toxic]:
            self.seen[toxic].add(name)
            self.counts[toxic, features] += 1

    def telling(self) -> np.ndarray:
        """Which features are found in a larger share of positives than of unlabelled texts, beyond chance."""
        (u, p), (n_u, n_p) = self.counts, map(len, self.seen)
        if not n_u or not n_p:
            return np.zeros(1 << BITS, bool)
        both = (p + u + 1) / (n_p + n_u + 2)
        apart = (p / n_p - u / n_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
        return (apart >= LEAST_Z) & (p / n_p >= LEAST_RATIO * u / n_u)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS, seed: int = 1) -> Classifier:
    """Minimise prior * E+[loss(+)] + max(0, Eu[loss(-)] - prior * E+[loss(-)]) for a linear model, by Adam over mini-batches.

    Each text is an array of its telling features. loss is the sigmoid one, which is flat for texts that are told
    clearly, so those near the boundary decide. Where the corrected risk of the negatives is below zero in a batch, that
    part stops at zero and gives no gradient, so the model can't gain by a risk that no classifier has. Without positives
    or unlabelled texts the prior alone is the model.
    """
    prior = float(np.clip(prior, 1e-3, 0.9))
    size = 1 << BITS
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Classifier(np.zeros(size), bias, prior)
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    b, bm, bv, step = bias, 0.0, 0.0, 0
    n_p = max(1, min(len(positive), BATCH // 3))
    n_u = max(1, min(len(unlabelled), BATCH - n_p))
    per_epoch = max(1, -(-max(len(positive) // n_p, len(unlabelled) // n_u)))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(per_epoch):
            take_p = order_p.take(np.arange(k * n_p, (k + 1) * n_p), mode="wrap")
            take_u = order_u.take(np.arange(k * n_u, (k + 1) * n_u), mode="wrap")
            docs = [positive[i] for i in take_p] + [unlabelled[i] for i in take_u]
            row, feature = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs)
            z = b + np.bincount(row, w[feature], len(docs))
            p = sigmoid(z)
            slope, g = p * (1 - p), np.zeros(len(docs))
            if p[n_p:].mean() - prior * p[:n_p].mean() >= 0:
                g[:n_p] = -2 * prior * slope[:n_p] / n_p
                g[n_p:] = slope[n_p:] / n_u
            else:
                g[:n_p] = -prior * slope[:n_p] / n_p
            touched = np.unique(feature)
            grad = np.bincount(np.searchsorted(touched, feature), g[row], len(touched)) + DECAY * w[touched]
            step += 1
            m[touched] = 0.9 * m[touched] + 0.1 * grad
            v[touched] = 0.999 * v[touched] + 0.001 * grad * grad
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            w[touched] -= rate * m[touched] / (np.sqrt(v[touched]) + 1e-8)
            gb = g.sum()
            bm, bv = 0.9 * bm + 0.1 * gb, 0.999 * bv + 0.001 * gb * gb
            b -= rate * bm / (np.sqrt(bv) + 1e-8)
    return Classifier(w, b, prior)


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", SMALL_SLICE):
        f = Features(b.column(1))
        cut = np.searchsorted(f.row, np.arange(f.n + 1))
        sets = [f.feature[x:y].astype("<i4").tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.record_batch([b.column(0), pa.array(sets, pa.binary())], names=["toxic", "features"])


def fold_of(doc_id: F.Column) -> F.Column:
    """crc32(id as text) mod 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Classifier:
    """A classifier from `labels`(id, toxic) of documents whose crc32(id as text) mod 5 is not 0.

    Positives are documents with label 1; the unlabelled ones are drawn from all documents of those folds, whatever
    their label says, so that the prior holds among them. The class prior is the share of label 1 among all labels of those folds. An id with both labels
    is toxic; null labels and null ids are no labels. Documents are drawn by the smallest hashes of their ids; of rows
    with one id all count, and equal texts count once in the choice of features. Empty tables, or no positives, leave the
    prior alone. The driver reads the drawn texts' features partition by partition and keeps the telling ones.
    """
    in_training = fold_of(F.col("id")) != 0
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").where(in_training)
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = marks.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    prior = n_toxic / n if n else PRIOR
    first = lambda df, most: df.orderBy(F.xxhash64("id"), "id").limit(most)
    positive = first(marks.where("toxic = 1").select("id"), most_positive)
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").where(in_training)
    rest = first(ids.distinct(), most_unlabelled)
    chosen = positive.withColumn("toxic", F.lit(1)).unionByName(rest.withColumn("toxic", F.lit(0)))  # at most both bounds in rows
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("toxic", "text")
    sets = keep(texts.mapInArrow(_feature_sets, "toxic int, features binary").orderBy("toxic", F.xxhash64("features")))
    shares = Shares()
    for r in sets.toLocalIterator():  # a partition at a time
        shares.add(r["toxic"], np.frombuffer(r["features"], "<i4"))
    used, told = shares.telling(), ([], [])
    for r in sets.toLocalIterator():
        features = np.frombuffer(r["features"], "<i4")
        told[r["toxic"]].append(features[used[features]])
    return fit(told[1], told[0], prior)


def scored(docs: DataFrame, model: Classifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs`, all columns, with the score of each text: the model's probability that it is toxic.

    A null or empty text has no features and gets the model's score for that; repeated rows are each scored, an empty
    table gives no rows. An existing column named `score_col` is replaced. Labels, languages, sources and ids are no inputs.
    """
    docs = docs.drop(score_col)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    hold = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = hold.value
        for b in slices(batches, text_col, SMALL_SLICE):
            f = Features(b.column(b.schema.get_field_index(text_col)))
            score = probability(f.scores(weights, bias))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, score_col])

    return small_batches(docs).mapInArrow(run, f"{shape}, `{score_col}` double")
