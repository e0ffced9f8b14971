"""SimHash near-duplicate groups found through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import components, join_by_key, keep, small, small_batches
from barwright.llm.setjoin import set_fingerprints, similar_groups
from barwright.llm.tokens import SMALL_SLICE, slices

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Buckets up to this size are compared within a task; larger ones go on to two-wildcard variants.
BUCKET = 1024
#: Buckets up to this size are compared pair by pair in one vector pass.
SMALL = 12
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the XXH64 values (seed 42) of a text's word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else (words,)
    ones, n, block = np.zeros(64, np.int64), 0, []

    def add(values: list[int]) -> None:
        ones[:] += np.unpackbits(np.array(values, ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)

    for run in runs:
        block.append(xxhash.xxh64_intdigest(b" ".join(run), SEED))
        if len(block) == _BLOCK:
            add(block)
            n += len(block)
            block = []
    if block:
        add(block)
    n += len(block)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long. A null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SMALL_SLICE):
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _wide(fps: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(fps), pa.nulls(len(fps), pa.int64())], names=["a", "b"])


def _spanning(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of a bucket to the smallest member of its linked group."""
    u = f.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    label = np.arange(len(u))
    while True:
        low = np.where(near, label[None, :], len(u)).min(1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    member = label != np.arange(len(u))
    return f[member], f[label[member]]


def _within(radius: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.int64)
        large = None  # the key of a bucket that has outgrown `bucket`

        def done(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.concatenate((begin, [len(k)])))
            left = np.repeat(size, size) - (np.arange(len(k)) - np.repeat(begin, size))  # rows from here to the bucket's end
            at = np.flatnonzero((left > 1) & (np.repeat(size, size) <= SMALL))
            for shift in range(1, SMALL):
                at = at[left[at] > shift]
                if not len(at):
                    break
                x, y = f[at], f[at + shift]
                near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
                if near.any():
                    yield _edges(x[near], y[near])
            for b, n in zip(begin[size > SMALL], size[size > SMALL], strict=True):
                yield _wide(f[b : b + n]) if n > bucket else _edges(*_spanning(f[b : b + n], radius))

        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if large is not None:
                n = int(np.searchsorted(k != large, True)) if k[0] == large else 0
                if n:
                    yield _wide(f[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                large = None
            key, fp = np.concatenate((key, k)), np.concatenate((fp, f))
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from done(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
            if len(key) > bucket:
                yield _wide(fp)
                large, key, fp = key[0], key[:0], fp[:0]
        if len(key):
            yield from done(key, fp)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (k, p): all rows with one (k, p) differ in the two masked bits at most, so neighbours are linked."""
    before = None
    for batch in batches:
        k, p, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if before is not None:
            k, p, f = (np.concatenate(([x], y)) for x, y in zip(before, (k, p, f), strict=True))
        same = (k[1:] == k[:-1]) & (p[1:] == p[:-1])
        yield _edges(f[1:][same], f[:-1][same])
        before = (k[-1], p[-1], f[-1])


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that keep every group linked at `radius` <= 2 bits connected.

    64 bits are cut into two segments, so of two fingerprints at most 2 bits apart one segment differs by at most one
    bit. Each segment is indexed under its 32 one-wildcard variants (the bit's place and the other 31 bits); equal
    variants meet in one sorted run and the whole fingerprints are verified. A run is read as a stream: up to `bucket`
    members it is compared in numpy and gives a spanning set of its links, never all pairs. A larger run is passed on
    to a second index, by the 62 bits left when any two are masked, where equal keys are links by themselves.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    key = F.expr("(cast(j as bigint) << 32) | (((fp >> (32 * (j div 32))) & 4294967295L) & ~(1L << (j % 32)))")
    spread = fps.select("fp", F.explode(F.expr("sequence(0L, 63L)")).alias("j")).select(key.alias("k"), "fp")
    found = keep(spread.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(_within(radius, bucket), "a long, b long").distinct())
    edges = found.where("b is not null")
    wide = found.where("b is null").select(F.col("a").alias("fp"))
    if wide.isEmpty():
        return edges
    bits = F.expr("flatten(transform(sequence(0L, 62L), i -> transform(sequence(i + 1, 63L), j -> i * 64 + j)))")
    if radius < 2:
        bits = F.expr("transform(sequence(0L, 63L), i -> i * 65)")
    masks = wide.select("fp", F.explode(bits).alias("p"))
    masked = masks.select(F.expr("fp & ~((1L << cast(p div 64 as int)) | (1L << cast(p % 64 as int)))").alias("k"), "p", "fp")
    return edges.unionByName(masked.repartition("k", "p").sortWithinPartitions("k", "p", "fp").mapInArrow(_chain, "a long, b long"))


def near_sets(sets: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of sets (fp, bits) that keep all linked whose fingerprints `bits` are linked at `radius` or fewer bits.

    Sets of one fingerprint are paired with the one of smallest fp, which stands for it in the links of fingerprints.
    """
    sets = keep(sets)
    lead = keep(sets.groupBy("bits").agg(F.min("fp").alias("lead"), F.count("*").alias("n")))
    same = join_by_key(sets, lead, "bits", "n").select(F.col("lead").alias("a"), F.col("fp").alias("b"))
    other = keep(links(lead.select(F.col("bits").alias("fp")), radius, bucket))
    for side in ("a", "b"):
        named = keep(other.groupBy(side).agg(F.count("*").alias(f"n_{side}")).join(lead.select(F.col("bits").alias(side), F.col("lead").alias(f"lead_{side}")), side))
        other = keep(join_by_key(other, named, side, f"n_{side}"))
    pairs = same.unionByName(other.select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, bucket: int, similarity: float | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(fp, root, component_id, copies) of each distinct fingerprint, and (id, fp) of each row (not for `similarity`)."""
    marked = None
    if similarity is None:
        marked = keep(fingerprints(docs, id_col, text_col, shingle))
        owners = keep(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("copies")))
        found = links(owners.select("fp"), radius, bucket)
    else:
        owners, found = similar_groups(docs, id_col, text_col, shingle, similarity, lambda sets: near_sets(sets, radius, bucket))
    roots = components(found).withColumnRenamed("node", "fp")
    grouped = keep(owners.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "copies"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("size"))
    return join_by_key(grouped, keep(lows), "root", "size").select("fp", "root", "component_id", "copies"), marked


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component_id) for each row: groups of texts whose fingerprints are linked at `radius` or fewer differing bits.

    component_id is the smallest id reachable. Null and empty texts have fingerprint 0 and are linked like any other;
    rows with a null id get their group's smallest id, or null if it has none; repeated rows are each returned; an
    empty table gives no rows; other columns are ignored. Equal fingerprints are merged before any comparison, and the
    rows of those with many copies are never shuffled.
    """
    of_fp, marked = _groups(docs, id_col, text_col, shingle, radius, bucket)
    return join_by_key(marked, keep(of_fp), "fp", "copies").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET, similarity: float | None = None) -> DataFrame:
    """The rows of `docs`, all columns, with one row of each near-duplicate group: the one with the smallest id.

    Groups are those of near_groups. With `similarity` they are those of setjoin.similar_groups, by the Jaccard similarity of
    shingle sets: SimHash links, of the sets' fingerprints, come first, the sets decide them, and a set join adds what the
    bits can't say.
    Where several rows have that id, or none of the group's ids is set, the smallest row by all columns stays. Null and
    empty texts are one group; an empty table gives no rows. Texts are shuffled once, to meet the ids that stay or, where
    few go, not at all; fingerprints and links carry none.
    """
    of_fp, _ = _groups(docs, id_col, text_col, shingle, radius, bucket, similarity)
    of_fp = keep(of_fp)
    lead = keep(of_fp.groupBy("root").agg(F.first("component_id").alias("id")).select("id"))
    ids = docs.select(F.col(id_col).alias("id"))
    many = small(ids.groupBy("id").count().where("count > 1 or id is null").select("id"))
    odd = small(lead.join(many, lead["id"].eqNullSafe(many["id"]), "left_semi").distinct())
    gone = small(ids.join(lead, "id", "left_anti").unionByName(odd.select("id")).distinct())
    once = docs.join(gone.select(F.col("id").alias("_gone")), docs[id_col].eqNullSafe(F.col("_gone")), "left_anti")
    if odd.isEmpty():
        return once
    row = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("id"), docs[id_col].alias("_key"), docs[text_col].alias("text"))
    shared = row.join(odd.select(F.col("id").alias("_odd")), F.col("_key").eqNullSafe(F.col("_odd")), "left_semi")
    key = f"c{docs.columns.index(id_col)}"
    mark = fingerprints(shared, "id", "text", shingle) if similarity is None else set_fingerprints(shared, "id", "text", shingle)
    named = mark.join(of_fp, "fp").where(F.col(f"id.{key}").eqNullSafe(F.col("component_id")))
    first = named.groupBy("root").agg(F.min("id").alias("id"))
    return once.unionByName(first.select(*[F.col(f"id.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
