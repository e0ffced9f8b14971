"""Groups of texts by the exact Jaccard similarity of their word-shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import components, join_by_key, keep, packed, small, small_batches, stash
from barwright.llm.tokens import SMALL_SLICE, slices

SEED = 42
SIMILARITY = 0.8
#: Sets that share an indexed shingle: up to SHORT of them are paired at once, more by tiles of about TILE sets.
SHORT, TILE = 6, 2048
#: Bits of the parity bitmap that bounds how far two sets are apart.
PARITY_BITS = 1024
#: Shingles found COMMON times in one of SAMPLE texts are indexed last; at most MOST_COMMON, which bears on speed alone.
SAMPLE, COMMON, MOST_COMMON = 16, 16, 200_000
_EPS = 1e-9

INDEX = "k long, fp long, n int, room int"


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct word shingles of a text as sorted XXH64 values (fewer words: the whole; none: no values)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else (words,)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), np.uint64))


def set_fingerprint(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def set_simhash(own: np.ndarray) -> int:
    """64-bit SimHash of a shingle set: a bit is 1 if set in over half of the values; 0 for no values."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(own), 1 << 16):
        ones += np.unpackbits(own[lo : lo + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big")


def set_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp): a 64-bit hash of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SMALL_SLICE):
            fps = np.fromiter((set_fingerprint(shingle_set(t, shingle)) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def common_shingles(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """Shingles that many texts hold, by a fixed sample of the distinct texts; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SMALL_SLICE):
            own = np.concatenate([np.zeros(0, np.uint64), *(shingle_set(t, shingle) for t in b.column(0).to_pylist())])
            yield pa.record_batch([pa.array(own.view(np.int64))], names=["h"])

    texts = docs.select(F.col(text_col).alias("text")).where(f"pmod(xxhash64(text), {SAMPLE}) = 0").distinct()
    found = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(id, fp, bits, n, prefix, late, parity, wide) of each row.

    fp, bits and n are a 64-bit hash, the SimHash and the size of its shingle set, prefix the shingles it is indexed under, of which the
    last `late` are common ones, parity a bitmap of how often, modulo 2, its shingles fall on each of PARITY_BITS places,
    and wide one of more places for a set of more than PARITY_BITS / 2 shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SMALL_SLICE):
            fps, bits, sizes, prefixes, lates, parities, wides = [], [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                own = shingle_set(t, shingle)
                n = len(own)
                is_late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own if len(common) else np.zeros(n, bool)
                first = n - int(np.ceil(similarity * n - _EPS)) + 1 if n else 0
                rare = own[~is_late][:first]
                fps.append(set_fingerprint(own))
                bits.append(set_simhash(own))
                sizes.append(n)
                prefixes.append(np.concatenate((rare, own[is_late][: first - len(rare)])).tobytes())
                lates.append(first - len(rare))
                parities.append(parity(own, PARITY_BITS))
                wides.append(parity(own, 1 << (2 * n).bit_length()) if 2 * n > PARITY_BITS else None)
            fp, signs = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, bits))
            yield pa.record_batch([b.column(0), fp, signs, pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(lates, pa.int32()), pa.array(parities, pa.binary()), pa.array(wides, pa.binary())], names=["id", "fp", "bits", "n", "prefix", "late", "parity", "wide"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long, bits long, n int, prefix binary, late int, parity binary, wide binary")


def parity(own: np.ndarray, bits: int) -> bytes:
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def _indexed(common: bool):
    """(k, fp, n, room) for each rare, or each common, indexed shingle k; room is how many shingles of the set stand from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                own = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
                each = np.array([len(x) for x in own], np.int64)
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                take = (at >= np.repeat(each - b.column("late").to_numpy(), each)) == common
                n = np.repeat(b.column("n").to_numpy(), each)[take]
                k, fp = np.concatenate([np.zeros(0, np.int64), *own])[take], np.repeat(b.column("fp").to_numpy(), each)[take]
                yield pa.record_batch([pa.array(k), pa.array(fp), pa.array(n), pa.array((n - at[take]).astype(np.int32))], names=["k", "fp", "n", "room"])

    return run


def _enough(room: np.ndarray, other_room: np.ndarray, n: np.ndarray, other_n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets can be similar: so many shingles must be common, and the smaller set must hold them."""
    both = similarity / (1 + similarity) * (n.astype(np.int64) + other_n) - _EPS
    return (np.minimum(room, other_room) >= both) & (np.minimum(n, other_n) >= both)


def _runs(similarity: float):
    """From rows sorted by k: (null, a, null, null, b) for pairs of a short run that can be similar, and a long run's rows; runs of one row end here."""
    names, kinds = ["k", "fp", "n", "room", "other"], (np.int64, np.int64, np.int32, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = [np.zeros(0, kind) for kind in kinds], None  # long: the key of a run that goes on

        def rows(part: list[np.ndarray]) -> pa.RecordBatch:
            return pa.record_batch([*map(pa.array, part), pa.nulls(len(part[0]), pa.int64())], names=names)

        def done(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            k, fp, n, room = part
            begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.append(begin, len(k)))
            each = np.repeat(size, size)
            left = each - (np.arange(len(k)) - np.repeat(begin, size))
            at, found = np.flatnonzero((left > 1) & (each <= SHORT)), []
            for shift in range(1, SHORT):
                at = at[left[at] > shift]
                to = at + shift
                good = _enough(room[at], room[to], n[at], n[to], similarity) & (fp[at] != fp[to])
                x, y = fp[at[good]], fp[to[good]]
                found.append(np.stack((np.minimum(x, y), np.maximum(x, y)), 1))
            if SHORT > 1 and sum(map(len, found)):
                a, b = np.unique(np.concatenate(found), axis=0).T
                none = pa.nulls(len(a), pa.int32())
                yield pa.record_batch([pa.nulls(len(a), pa.int64()), pa.array(a), none, none, pa.array(b)], names=names)
            many = each > SHORT
            if many.any():
                yield rows([x[many] for x in part])

        for batch in batches:
            part = [batch.column(i).to_numpy() for i in range(4)]
            if long is not None:
                m = int(np.searchsorted(part[0], long, "right"))
                if m:
                    yield rows([x[:m] for x in part])
                part = [x[m:] for x in part]
                if not len(part[0]):
                    continue
                long = None
            held = [np.concatenate(x) for x in zip(held, part, strict=True)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield from done([x[:last] for x in held])
                held = [x[last:] for x in held]
            if len(held[0]) > SHORT:
                long = held[0][0]
                yield rows(held)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from done(held)

    return run


def _parities(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Places in which parities differ: no more than the shingles that only one of two sets has."""
    return np.bitwise_count(p ^ q).sum(-1, dtype=np.int64)


def _tile(t: dict[str, np.ndarray], similarity: float, how: str) -> np.ndarray:
    """Candidate pairs of one tile, rows of different labels that can be similar.

    `leaders`: each row with one earlier row that is likely similar, if there is any and it is of another label; `nearest`: each row that is not of
    the tile's most frequent label with the nearest row of another label; `all`: all such pairs.
    """
    fp, n, room, label, parity = (t[c] for c in ("fp", "n", "room", "label", "parity"))
    most = (1 - similarity) / (1 + similarity)
    found = [np.zeros((0, 2), np.int64)]

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        found.append(np.stack((np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])), 1))

    if how == "leaders":
        order = np.argsort(n, kind="stable")
        fp, n, room, label, parity = (x[order] for x in (fp, n, room, label, parity))
        end = np.searchsorted(n, n / similarity + _EPS, "right")
        # expected bits apart for so many shingles that only one set has, by the size of both sets
        bound = PARITY_BITS / 2 * -np.expm1(-2 * most * np.arange(2 * int(n[-1]) + 1) / PARITY_BITS)
        free = np.ones(len(n), bool)
        for i in range(len(n) - 1):
            if free[i]:
                j = np.flatnonzero(free[i + 1 : end[i]]) + i + 1
                j = j[_enough(room[i], room[j], n[i], n[j], similarity)]
                j = j[_apart(parity[i], parity[j]) <= bound[n[i] + n[j]]]
                free[j] = False
                j = j[label[j] != label[i]]
                pairs(np.full(len(j), i), j)
        return np.concatenate(found)
    labels, number, size = np.unique(label, return_inverse=True, return_counts=True)
    main = number == size.argmax()
    others = np.flatnonzero(~main)
    for lo in range(0, len(others), 64):
        i = others[lo : lo + 64, None]
        can = (number[i] != number) & _enough(room[i], room, n[i], n, similarity)
        if how == "all":
            can &= main | (fp[i] < fp)
        p, q = np.nonzero(can)
        p = i[p, 0]
        apart = _apart(parity[p], parity[q])
        good = apart <= most * (n[p].astype(np.int64) + n[q]) + _EPS
        p, q, apart = p[good], q[good], apart[good]
        if how == "nearest" and len(p):
            order = np.lexsort((fp[q], apart, p))
            p, q = p[order], q[order]
            lead = np.concatenate(([True], p[1:] != p[:-1]))
            p, q = p[lead], q[lead]
        pairs(p, q)
    return np.concatenate(found)


def _tiles(similarity: float, how: str):
    """The candidate pairs of all tiles, from rows sorted by (k, x, y); a tile is held whole, which its size allows."""
    names = ["k", "x", "y", "fp", "n", "room", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(part)
            v = {c: t.column(c).to_numpy() for c in names} | {"parity": _parities(t.column("parity"))}
            begin = np.flatnonzero(np.concatenate(([True], (v["k"][1:] != v["k"][:-1]) | (v["x"][1:] != v["x"][:-1]) | (v["y"][1:] != v["y"][:-1]))))
            found = [_tile({c: x[lo:hi] for c, x in v.items()}, similarity, how) for lo, hi in zip(begin, np.append(begin[1:], len(v["k"])), strict=True)]
            a, b = np.unique(np.concatenate(found), axis=0).T
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in names[:3]]
            last = int(np.argmax((key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])))
            if last or (held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in names[:3])):
                yield from done([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield from done(held)

    return run


def _possible(similarity: float):
    """Of pairs with both sides' sizes and bitmaps, those whose bitmaps allow the similarity."""
    most = (1 - similarity) / (1 + similarity)

    def wide_apart(x: bytes, y: bytes) -> int:
        x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
        return int(_apart(x, np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            can = _apart(_parities(b.column("parity_a")), _parities(b.column("parity_b"))) <= most * n + _EPS
            for i in np.flatnonzero(can):
                x, y = b.column("wide_a")[i].as_py(), b.column("wide_b")[i].as_py()
                can[i] = x is None or y is None or wide_apart(x, y) <= most * n[i] + _EPS
            yield b.select(["a", "b"]).filter(pa.array(can))

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("own_a"), b.column("own_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - _EPS)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _with_sides(pairs: DataFrame, of: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(of.select(*[F.col(c).alias(side if c == "fp" else f"{c}_{side}") for c in of.columns]), side)
    return pairs


def _apart_in(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one of the groups (node, root)."""
    groups = small(groups)
    for side in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def similar_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, near: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(fp, low, copies) of each distinct shingle set, low the smallest id that has it, and edges (a, b) between sets
    of Jaccard similarity `similarity` or more that keep every group linked.

    SimHash comes first: near((fp, bits) of all sets) returns pairs (a, b) of sets with near fingerprints, and those that
    are similar by the sets are the first edges. The join by prefixes adds the links that bits can't say: it pairs sets of
    different groups alone.

    In one order of all shingles, two sets of n and m that are similar share one of their first n - ceil(similarity n) + 1
    and m - ceil(similarity m) + 1. Each set is indexed under these, common ones last; sets that meet under a shingle
    form a run. Two sets can be similar only if enough shingles stand from their first common one on and their parity
    bitmaps differ in few places, which holds for all similar pairs; every pair that can be similar is decided by the sets
    (64-bit shingle hashes), but for pairs that are in one group already.

    Runs of up to SHORT sets are paired at once. Longer ones are dealt out in tiles: first each set is linked to a likely
    neighbour, then to the nearest set outside its group, and at last all pairs of different groups are compared. Common
    shingles go to tiles directly, so that no run passes through one task.
    """
    common = common_shingles(small_batches(docs), text_col, shingle)
    every = described(docs, id_col, text_col, shingle, similarity, common)
    first = [F.first(c).alias(c) for c in ("bits", "n", "prefix", "late", "parity", "wide")]
    rows = stash(every.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("copies"), *first), "shingle-sets")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SMALL_SLICE):
            own = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(np.array([set_fingerprint(x) for x in own], np.uint64).view(np.int64)), pa.array([x.tobytes() for x in own], pa.binary())], names=["fp", "own"])

    def similar(p: DataFrame) -> DataFrame:
        """The pairs that are similar: those that their bitmaps allow are decided by the sets of their texts."""
        p = packed(_with_sides(p, rows.select("fp", "n", "parity", "wide")).select("a", "b", "n_a", "n_b", "parity_a", "parity_b", "wide_a", "wide_b").mapInArrow(_possible(similarity), "a long, b long"))
        wanted = packed(p.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
        ids = small(wanted.join(rows.select("fp", "low"), "fp").select("low").distinct(), 500_000)
        own = texts.join(ids, texts["id"].eqNullSafe(ids["low"]), "left_semi").select("text").mapInArrow(owned, "fp long, own binary")
        sets = stash(own.join(small(wanted, 500_000), "fp", "left_semi"), "shingles").dropDuplicates(["fp"])
        return packed(_with_sides(p, sets).select("a", "b", "own_a", "own_b").mapInArrow(_similar(similarity), "a long, b long"))

    near_pairs = packed(near(rows.select("fp", "bits")))
    edges = None if near_pairs.isEmpty() else similar(near_pairs)
    groups = None if edges is None else components(edges)
    sets_of = rows.select("fp", "n", "prefix", "late")
    met = sets_of.mapInArrow(_indexed(False), INDEX).repartition("k").sortWithinPartitions("k").mapInArrow(_runs(similarity), f"{INDEX}, other long")
    met = stash(met, "shingle-runs")
    pairs = met.where("k is null").select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()
    if groups is not None:
        pairs = _apart_in(pairs, groups)
    long = met.where("k is not null").drop("other").unionByName(sets_of.where("late > 0").mapInArrow(_indexed(True), INDEX))
    for how in ("leaders", "nearest", "all"):
        labelled = long.withColumn("label", F.col("fp"))
        if edges is not None:
            groups = groups if how == "leaders" else components(edges)
            labelled = keep(long.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(*long.columns, F.coalesce("root", "fp").alias("label")))
        mixed = labelled.groupBy("k").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        mixed = packed(mixed.where("lo <> hi").selectExpr("k", "size", f"cast(ceil(size / {TILE}) as int) as tiles"))
        if mixed.isEmpty():
            more = pairs if how == "leaders" else None
        else:
            dealt = join_by_key(labelled, mixed, "k", "size").join(rows.select("fp", "parity"), "fp")
            dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(fp), tiles) as int)")).withColumn("to", F.expr("explode(sequence(0, tiles - 1))"))
            tiles = dealt.select("k", F.least("own", "to").alias("x"), F.greatest("own", "to").alias("y"), "fp", "n", "room", "label", "parity")
            more = tiles.repartition("k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(_tiles(similarity, how), "a long, b long")
            more = packed((more.unionByName(pairs) if how == "leaders" else more).distinct())
        if more is None or more.isEmpty():
            if how == "leaders":
                continue
            break
        found = similar(more)
        edges = found if edges is None else packed(edges.unionByName(found))
    return rows.select("fp", "low", "copies"), edges if edges is not None else pairs
