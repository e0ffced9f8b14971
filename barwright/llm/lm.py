"""A bigram language model with deleted interpolation, counted and applied over blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import stash
from barwright.llm.tokens import LOWER, SPACE, Words, crc32_of, flat, slices

FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: About so many bytes of text make a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: About so many distinct n-grams of blocks meet in one group of the counting step.
GROUP_KEYS = 2_000_000
#: A block's keys go to at most so many ranges; where the corpus needs more groups, runs of blocks are split further together.
RANGES = 4096
#: Contexts seen up to 0, 1, 2, 4, ... 2^14 times, and more.
BUCKETS = 17
#: Width, in powers of two, of the bins in which EM sees the ratios of its components; ratios reach from 2^-40 to 2^40.
BIN = 1 / 16
_BINS = int(80 / BIN) + 1
ROUNDS = 50
#: Hashes of the end token and of the context that stands before a text.
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)

#: A block of all documents of a stretch, or, `again`, of its deleted ones alone, which EM asks for.
BLOCKS = "block long, again boolean, ids array<{kind}>, fold array<tinyint>, lens array<int>, words binary, tokens binary, n_keys int"


def _pack(x: np.ndarray) -> bytes:
    """Numbers compressed byte by byte place: their high bytes are mostly equal."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unpack(x: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class Block:
    """Tokens of some documents, as numbers of the block's distinct words, and the keys of their n-grams."""

    def __init__(self, fold: np.ndarray, lens: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        self.fold, self.lens = fold, lens
        self.n = len(tokens)
        hashes = words[tokens]
        begin = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)
        before = np.empty(self.n, np.uint64)
        before[1:] = hashes[:-1]
        before[begin] = _START
        self.begin = begin
        self.doc = np.repeat(np.arange(len(lens)), lens)
        # The lowest bit tells bigrams from single words; the highest ones choose the group.
        self.one = _scramble(hashes) & ~np.uint64(1)
        self.two = _scramble(before * np.uint64(3) ^ _scramble(hashes)) | np.uint64(1)
        self.keys = self._distinct(np.concatenate((np.unique(_scramble(words) & ~np.uint64(1)), self.two)))

    @staticmethod
    def _distinct(x: np.ndarray) -> np.ndarray:
        x = np.sort(x)
        return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x

    def place(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)

    def tally(self, in_docs: np.ndarray) -> np.ndarray:
        """Occurrences of each key in the chosen documents."""
        at = in_docs[self.doc]
        found = np.sort(np.concatenate((self.one[at], self.two[at])))
        return np.searchsorted(found, self.keys, "right") - np.searchsorted(found, self.keys, "left")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for b in slices(batches, "text", BLOCK_BYTES):
        data, off = flat(b.column(1))
        w = Words(LOWER[data], off, SPACE)
        ids, distinct = w.encode()
        hashes = np.fromiter((xxhash.xxh64_intdigest(x.as_buffer(), 1) for x in distinct), np.uint64, len(distinct))
        lens = np.diff(w.rows) + 1
        codes = np.insert(ids, w.rows[1:], len(distinct))
        hashes = np.append(hashes, _END)
        fold = (crc32_of(b.column(0)) % FOLDS).astype(np.int8)
        for again, take in ((False, np.ones(len(fold), bool)), (True, fold == DELETED)):
            if not take.any():
                continue
            own = codes[np.repeat(take, lens)]
            used = np.flatnonzero(np.bincount(own, minlength=len(hashes)))
            words, rank = np.unique(hashes[used], return_inverse=True)
            number_of = np.zeros(len(hashes), np.int32)
            number_of[used] = rank
            tokens = number_of[own]
            block = Block(fold[take], lens[take], words, tokens)
            whole = pa.array([0, int(take.sum())], pa.int32())
            yield pa.record_batch(
                [pa.array([number]), pa.array([again]), pa.ListArray.from_arrays(whole, b.column(0).filter(pa.array(take))), pa.array([fold[take]]), pa.array([lens[take].astype(np.int32)]), pa.array([_pack(np.diff(words, prepend=np.uint64(0)))], pa.binary()), pa.array([_pack(tokens)], pa.binary()), pa.array([len(block.keys)], pa.int32())],
                names=[x.split()[0] for x in BLOCKS.split(", ")],
            )
        number += 1


def _load(fold, lens, words: bytes, tokens: bytes) -> Block:
    return Block(np.array(fold), np.array(lens, np.int64), np.cumsum(_unpack(words, np.uint64), dtype=np.uint64), _unpack(tokens, np.int32))


def _cuts(keys: np.ndarray, groups: int) -> np.ndarray:
    """Where each group's range of the key space begins in sorted keys."""
    edges = np.array([(g << 64) // groups for g in range(groups)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _asked(groups: int):
    """For each block and group: the block's keys, and how often its documents to count and its deleted ones hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r] for n in b.schema.names}
                block = _load(row["fold"].values.to_numpy(), row["lens"].values.to_numpy(), row["words"].as_py(), row["tokens"].as_py())
                again = row["again"].as_py()
                fit = block.tally((block.fold != HELD_OUT) & (block.fold != DELETED)).astype(np.uint32)
                deleted = block.tally(block.fold == DELETED).astype(np.uint32) * np.uint32(not again)  # counted once
                cut = _cuts(block.keys, groups)
                full = np.flatnonzero(cut[1:] > cut[:-1])
                part = lambda x: [_pack(x[cut[g] : cut[g + 1]]) for g in full]  # noqa: B023, E731
                first = np.concatenate((block.keys[:1], np.diff(block.keys)))
                first[cut[full]] = block.keys[cut[full]]  # each group's keys as differences
                yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array([row["block"].as_py()] * len(full), pa.int64()), pa.array([again] * len(full)), pa.array(part(first), pa.binary()), pa.array(part(fit), pa.binary()), pa.array(part(deleted), pa.binary())], names=["g", "block", "again", "keys", "fit", "deleted"])

    return run


ASKED = "g int, block long, again boolean, keys binary, fit binary, deleted binary"
ANSWERED = "g int, block long, again boolean, counts binary, types long, fit_types long"


def _keys(table: pa.Table) -> list[np.ndarray]:
    return [np.cumsum(_unpack(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]


def _merged(ranges: int, parts: int):
    """The rows of one range and run of blocks as one for each of the range's parts: distinct keys and their sums."""

    def run(table: pa.Table) -> pa.Table:
        every = np.concatenate(_keys(table))
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        begin = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        keys = ranked[begin]
        sums = {n: np.add.reduceat(np.concatenate([_unpack(x, np.uint32) for x in table.column(n).to_pylist()])[order].astype(np.int64), begin).astype(np.uint32) for n in ("fit", "deleted")}
        first = table.column("g")[0].as_py() * parts
        edges = np.array([((first + s) << 64) // (ranges * parts) for s in range(parts)], np.uint64)
        cut = np.append(np.searchsorted(keys, edges), len(keys))
        cut[0] = 0
        full = np.flatnonzero(cut[1:] > cut[:-1])
        step = np.diff(keys, prepend=np.uint64(0))
        step[cut[full]] = keys[cut[full]]
        part = lambda x: pa.array([_pack(x[cut[s] : cut[s + 1]]) for s in full], pa.binary())
        same = lambda name, n=len(full): pa.array([table.column(name)[0].as_py()] * n)
        return pa.table({"g": pa.array((first + full).astype(np.int32)), "block": same("bucket"), "again": same("again"), "keys": part(step), "fit": part(sums["fit"]), "deleted": part(sums["deleted"])})

    return run


def _dealt(left: pa.Table, right: pa.Table) -> pa.Table:
    """The counts of a range and run of blocks, back in the order of each block's keys."""
    own = _keys(left)
    keys = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
    counts = np.concatenate([*(_unpack(x, np.int64) for x in right.sort_by("g").column("counts").to_pylist()), np.zeros(0, np.int64)])
    none = pa.array(np.zeros(left.num_rows, np.int64))
    found = pa.array([_pack(counts[np.searchsorted(keys, k)]) for k in own], pa.binary())
    return pa.table({"g": left.column("g"), "block": left.column("block"), "again": left.column("again"), "counts": found, "types": none, "fit_types": none})


def _answers(asked: DataFrame, n_blocks: int, ranges: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(answers to each block and range, the table that has the numbers of types).

    With several parts a range, a group of the counting step is a part: first the rows of a range are merged for runs of
    as many blocks as there are parts, so that rows grow in proportion to the blocks, and its answers are dealt out again.
    """
    if parts == 1:
        answers = stash(asked.groupBy("g").applyInArrow(_answer, ANSWERED), "lm-counts")
        return answers, answers
    asked = stash(asked.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(max(1, n_blocks // parts)))), "lm-asked")
    run = ["g", "bucket", "again"]
    merged = asked.groupBy(*run).applyInArrow(_merged(ranges, parts), ASKED)
    totals = stash(merged.groupBy("g").applyInArrow(_answer, ANSWERED), "lm-parts")
    back = totals.select(F.expr(f"g div {parts}").cast("int").alias("_g"), F.col("block").alias("bucket"), "again", "g", "counts")
    answers = asked.groupBy(*run).cogroup(back.groupBy("_g", "bucket", "again")).applyInArrow(_dealt, ANSWERED)
    return stash(answers, "lm-counts"), totals


def _answer(table: pa.Table) -> pa.Table:
    """The counts over all blocks of the keys that each block asked for, in its order: for EM without the deleted documents."""
    keys = _keys(table)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    begin, number = np.flatnonzero(new), np.cumsum(new) - 1
    out = {}
    for name in ("fit", "deleted"):
        counts = np.concatenate([_unpack(x, np.uint32) for x in table.column(name).to_pylist()])[order].astype(np.int64)
        out[name] = np.add.reduceat(counts, begin)
    back = np.empty(len(order), np.int64)
    back[order] = number
    ends = np.cumsum([len(k) for k in keys])
    total = out["fit"] + out["deleted"]
    again = table.column("again").to_pylist()
    counts = [_pack((out["fit"] if a else total)[at]) for a, at in zip(again, np.split(back, ends[:-1]), strict=True)]
    known = int(((total > 0) & (ranked[begin] & np.uint64(1) == 0)).sum())
    fitted = int(((out["fit"] > 0) & (ranked[begin] & np.uint64(1) == 0)).sum())
    n = table.num_rows
    return pa.table({"g": table.column("g"), "block": table.column("block"), "again": table.column("again"), "counts": pa.array(counts, pa.binary()), "types": pa.array([known] + [0] * (n - 1), pa.int64()), "fit_types": pa.array([fitted] + [0] * (n - 1), pa.int64())})


def _pairs(blocks: DataFrame, answers: DataFrame, again: bool, work, schema: str) -> DataFrame:
    """work(block row, counts of its keys) for each block with its answers."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = [_unpack(x, np.int64) for x in right.sort_by("g").column("counts").to_pylist()]
        return work({n: left.column(n)[0] for n in left.schema.names}, np.concatenate([*counts, np.zeros(0, np.int64)]))

    mine = F.col("again") == again
    return blocks.where(mine).drop("again").groupBy("block").cogroup(answers.where(mine).select("block", "g", "counts").groupBy("block")).applyInArrow(both, schema)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.ceil(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def _components(block: Block, at: np.ndarray, counts: np.ndarray, tokens: float, types: float, starts: float) -> tuple[np.ndarray, ...]:
    """Context bucket, and the bigram, single-word and uniform estimates, of the tokens at `at`."""
    single = counts[block.place(block.one[at])]
    double = counts[block.place(block.two[at])]
    context = np.empty(len(at), np.int64)
    first = np.zeros(block.n, bool)
    first[block.begin] = True
    first = first[at]
    context[first] = starts
    context[~first] = counts[block.place(block.one[at[~first] - 1])]
    return _bucket(context), double / np.maximum(context, 1), single / max(tokens, 1), np.full(len(at), 1 / (types + 1)), single


@dataclass
class Model:
    """N and V over the training tokens, the number of training documents, and the weights (bucket x component)."""

    tokens: int
    types: int
    starts: int
    weights: np.ndarray


def learn_weights(cells: list[tuple[int, int, int, float]], rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of (bigram, single, uniform) for each context bucket, by expectation-maximisation.

    cells: (bucket, bin of bigram / uniform, bin of single / uniform, tokens); bin -1 stands for a zero estimate. A
    bucket without tokens takes the weights over all buckets. Half a token of each component is added to each bucket,
    so that no weight becomes zero but the bigram's in contexts never seen.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    if not cells:
        return weights
    b, two, one, n = (np.array(x) for x in zip(*cells, strict=True))
    ratio = lambda k: np.where(k < 0, 0.0, 2.0 ** ((k - _BINS // 2) * BIN))
    parts = np.stack((ratio(two), ratio(one), np.ones(len(n))), 1)
    parts[b == 0, 0] = 0
    for _ in range(rounds):
        share = weights[b] * parts
        share *= (n / share.sum(1))[:, None]
        total = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], 1)
        seen = total.sum(1, keepdims=True) > 0
        total = np.where(seen, total, total[1:].sum(0)) + np.where(seen, 0.5, 0.5)
        total[0, 0] = 0
        weights = total / total.sum(1, keepdims=True)
    return weights


def _cells(tokens: float, types: float, starts: float):
    def work(row: dict, counts: np.ndarray) -> pa.Table:
        block = _load(row["fold"].values.to_numpy(), row["lens"].values.to_numpy(), row["words"].as_py(), row["tokens"].as_py())
        at = np.arange(block.n)
        bucket, two, one, flat_p, _ = _components(block, at, counts, tokens, types, starts)
        to_bin = lambda p: np.where(p > 0, np.clip(np.rint(np.log2(np.maximum(p, 1e-300) / flat_p) / BIN) + _BINS // 2, 0, _BINS - 1), -1).astype(np.int64)
        cell, n = np.unique((bucket * (_BINS + 1) + to_bin(two) + 1) * (_BINS + 1) + to_bin(one) + 1, return_counts=True)
        return pa.table({"cell": pa.array(cell), "n": pa.array(n)})

    return work


def _scores(kind: pa.DataType, model: Model):
    def work(row: dict, counts: np.ndarray) -> pa.Table:
        block = _load(row["fold"].values.to_numpy(), row["lens"].values.to_numpy(), row["words"].as_py(), row["tokens"].as_py())
        bucket, two, one, flat_p, c = _components(block, np.arange(block.n), counts, model.tokens, model.types, model.starts)
        w = model.weights[bucket]
        p = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * flat_p)
        base = np.log10((c + 1) / (model.tokens + model.types + 1))
        total = lambda x: np.bincount(block.doc, x, len(block.lens))
        return pa.table({"id": pa.array(row["ids"].values, kind), "held_out": pa.array(block.fold == HELD_OUT), "n_tokens": pa.array(block.lens), "n_known": pa.array(total(c > 0).astype(np.int64)), "base_score": pa.array(total(base)), "score": pa.array(total(p))})

    return work


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row, and the model.

    Documents whose crc32(id as text) mod 7 is not 2 train. Those with remainder 3 are first deleted: the counts of the
    others give maximum-likelihood estimates, and EM on the deleted documents' n-grams finds the weights of bigram,
    single-word and uniform estimate in each bucket of the context's frequency. The counts of all training documents
    then score every document: score is the log10 probability of its words and its end. base_score adds one to the
    single-word counts: log10((c + 1) / (N + (V + 1))).

    Documents are cut into words once, into a table of blocks of about 8 MB of text. A block asks for the counts of its
    distinct n-grams, by ranges of 63-bit n-gram hashes (two of 10^9 words collide with probability 0.05); each range
    adds up what all blocks hold and answers each block in its order. So a frequent word is one key a block, whatever
    its count. A block has rows for at most RANGES ranges; a larger corpus splits them further for runs of blocks. EM sees its components' ratios in bins of 2^(1/16), at most buckets x bins^2 sums.

    Null and empty texts are the end token alone; a null id counts as empty text in the crc; repeated rows count and
    score each; an empty table gives no rows; without training documents all estimates but the uniform one are zero.
    Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    blocks = stash(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_blocks, BLOCKS.format(kind=kind)), "lm-blocks")
    token_sum = lambda keep_fold: F.coalesce(F.sum(F.expr(f"if(again, 0L, aggregate(zip_with(fold, lens, (f, l) -> if({keep_fold}, cast(l as bigint), 0L)), 0L, (a, x) -> a + x))")), F.lit(0))
    doc_sum = lambda keep_fold: F.coalesce(F.sum(F.expr(f"if(again, 0, size(filter(fold, f -> {keep_fold})))")), F.lit(0))
    train, fit = f"f <> {HELD_OUT}", f"f <> {HELD_OUT} and f <> {DELETED}"
    n_train, n_fit, d_train, d_fit, n_keys, n_blocks = blocks.agg(token_sum(train), token_sum(fit), doc_sum(train), doc_sum(fit), F.coalesce(F.sum("n_keys"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-n_keys // GROUP_KEYS), int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    ranges, parts = min(groups, RANGES), -(-groups // RANGES)
    asked = blocks.select("block", "again", "fold", "lens", "words", "tokens").mapInArrow(_asked(ranges), ASKED)
    answers, counted = _answers(asked, n_blocks, ranges, parts)
    types, fit_types = counted.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("fit_types"), F.lit(0))).first()
    held = _pairs(blocks.select("block", "again", "fold", "lens", "words", "tokens"), answers, True, _cells(n_fit, fit_types, d_fit), "cell long, n long")
    cells = []
    for r in held.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # bounded by buckets and bins
        rest, one = divmod(r["cell"], _BINS + 1)
        bucket, two = divmod(rest, _BINS + 1)
        cells.append((bucket, two - 1, one - 1, r["n"]))
    model = Model(n_train, types, d_train, learn_weights(cells))
    ids = blocks.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    scored = _pairs(blocks, answers, False, _scores(to_arrow_type(ids), model), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"), model
