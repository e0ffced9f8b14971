"""Shards of nearly equal bytes by histogram sort: probe, count, refine, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import keep, small_batches

SHARDS = 8
#: Share of a part's bytes by which a splitter may miss its place.
TOLERANCE = 0.002
KEYS = ("k0", "k1", "k2")
#: Rounds of a level: the bits below the probes, and how many bits the probes take.
_ROUNDS = ((52, 12), (40, 12), (28, 12), (16, 12), (4, 12), (0, 4))
_LOW = -(1 << 63)


def _crossed(rows: DataFrame, level: int, shift: int, bits: int, slack: float, wanted: dict[tuple, tuple[int, list[float]]]) -> dict[tuple, list[tuple]]:
    """For each open interval, the probe cells in which its splitters are settled or go on: (cell, bytes below, bytes, rows, key if only one).

    wanted: bytes below an interval and the splitters' targets in it, by the unsigned keys of the levels so far. Bytes
    below each probe are exact sums over all partitions; of all cells only those that a target falls on reach the driver,
    at most one for each.
    """
    order = lambda k: F.col(KEYS[k]).bitwiseXOR(F.lit(_LOW))  # noqa: E731  signed order as unsigned bits
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    starts = sorted(wanted)
    data = [(i, *map(signed, s), *wanted[s]) for i, s in enumerate(starts)]
    spec = rows.sparkSession.createDataFrame(data, "at int, " + ", ".join(f"o{k} long" for k in range(level + 1)) + ", base long, wants array<double>")
    on = F.lit(True)
    for k in range(level):
        on = on & (order(k) == F.col(f"o{k}"))
    if shift + bits < 64:
        on = on & (F.shiftrightunsigned(order(level), shift + bits) == F.shiftrightunsigned(f"o{level}", shift + bits))
    whole = level == 0 and shift + bits == 64
    inside = rows.withColumn("at", F.lit(0)) if whole else rows.join(F.broadcast(spec.drop("base", "wants")), on)  # a row for each open interval, at most one a part
    cell = F.shiftrightunsigned(order(level), shift).bitwiseAND(F.lit((1 << bits) - 1))
    key = F.col(KEYS[level])
    cells = inside.groupBy("at", cell.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    w = Window.partitionBy("at").orderBy("cell")
    cells = cells.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lag("size").over(w))
    cells = cells.join(F.broadcast(spec.select("at", "base", "wants")), "at").withColumn("below", F.col("base") + F.col("upto") - F.col("size"))
    near, far = (lambda x, t: F.abs(x - t) <= slack), (lambda x, t: x < t - slack)
    before = F.col("below") - F.col("last")
    settled = lambda t: near(F.col("below"), t) & (F.col("last").isNull() | far(before, t))
    crossed = lambda t: far(F.col("below"), t) & (F.col("below") + F.col("size") > t + slack)
    out: dict[tuple, list[tuple]] = {}
    for r in cells.where(F.exists("wants", lambda t: settled(t) | crossed(t))).select("at", "cell", "below", "size", "n", "low", "high").collect():
        out.setdefault(starts[r["at"]], []).append((r["cell"], r["below"], r["size"], r["n"], r["low"] - _LOW if r["low"] == r["high"] else None))
    return out


def splitters(rows: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """parts - 1 boundaries in (k0, k1, k2) order, as signed longs; a row belongs right of each that is <= its keys.

    Every round counts the exact bytes below each candidate boundary, over all partitions of rows(k0, k1, k2, size),
    with up to 4096 probes in each interval that still holds a splitter. A splitter is settled once the bytes below it
    are within `tolerance` of a part from its target; the driver gets at most a row for each splitter and round. Rows with
    equal k0 are cut apart only where whole k0 values can't meet the tolerance, then by k1, and last by k2.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / parts
    done: dict[int, tuple] = {}
    waiting = {p: ((0,), 0) for p in range(1, parts)} if total else {}
    for level in range(len(KEYS)):
        for shift, bits in _ROUNDS:
            if not waiting:
                break
            wanted: dict[tuple, tuple[int, list[float]]] = {}
            for p, (lo, at) in waiting.items():
                wanted.setdefault(lo, (at, []))[1].append(p * total / parts)
            found = _crossed(rows, level, shift, bits, slack, wanted)
            after, single = {}, True
            for p, (lo, at) in waiting.items():
                want, top = p * total / parts, lo[-1] >> (shift + bits) << (shift + bits)
                for cell, below, size, n, only in sorted(found.get(lo, [])):
                    start, end = ((*lo[:-1], top + (c << shift)) for c in (cell, cell + 1))
                    if abs(below - want) <= slack:
                        done[p] = start
                        break
                    if below < want and below + size > want + slack:
                        if n == 1:  # no boundary lies nearer than before or after this row
                            done[p] = start if want - below <= below + size - want else end
                        else:
                            after[p] = (start if only is None else (*lo[:-1], only), below)
                            single &= only is not None
                        break
                else:
                    done[p] = (*lo[:-1], top + (1 << (shift + bits)))
            waiting = after
            if single:  # each open interval is down to one key: the next level goes on
                break
        waiting = {p: ((*lo, 0), at) for p, (lo, at) in waiting.items()}
    done.update({p: lo[:3] for p, (lo, _) in waiting.items()})  # rows with equal keys can't be cut apart
    pad = lambda s: tuple(min(x, (1 << 64) - 1) + _LOW for x in (*s, 0, 0)[:3])
    return sorted(pad(done[p]) if p in done else (-_LOW - 1,) * 3 for p in range(1, parts))


def _right_of(keys: list[np.ndarray], cuts: np.ndarray) -> np.ndarray:
    """For each row, how many of the sorted cuts are <= its keys, the first key first."""
    part, most = (np.searchsorted(cuts[:, 0], keys[0], side) for side in ("left", "right"))
    if cuts.shape[1] == 1:
        return most
    tied = np.flatnonzero(part < most)  # on a boundary: the other keys decide
    for first in np.unique(part[tied]):
        rows = tied[part[tied] == first]
        part[rows] = first + _right_of([k[rows] for k in keys[1:]], cuts[first : most[rows[0]], 1:])
    return part


def _place(cuts: list[tuple[int, int, int]], per: int):
    table = np.array(cuts, np.int64).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = _right_of([b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in KEYS], table).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(part // per, pa.int32())], names=[*b.schema.names, "_part", "_shard"])

    return run


def _slots(offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            part = b.column(b.schema.get_field_index("_part")).to_numpy(zero_copy_only=False)
            slot = np.zeros(len(part), np.int64)
            for p in np.unique(part).tolist():
                here = part == p
                n = int(here.sum())
                slot[here] = offsets[p] + seen.get(p, 0) + np.arange(n)
                seen[p] = seen.get(p, 0) + n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slot)], names=[*b.schema.names, "_slot"])

    return run


def histogram_shards(rows: DataFrame, sizes: DataFrame | None = None, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """`rows` with _part, _shard and _slot (a row's place in its shard in key order, gapless from 0).

    rows has non-null longs k0, k1, k2, by which it is ordered, and size; `sizes` may give these four columns alone, for
    the counting rounds. Each shard is made of several parts, as many in all as there are shuffle partitions; the parts
    are nearly equal in bytes too, so no task gets a whole shard. The rows move in one exchange, to their part.
    """
    sizes = rows if sizes is None else sizes
    per = max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    cuts = splitters(sizes, shards * per, tolerance)
    where = "_part int, _shard int"
    narrow = sizes.select(*KEYS).mapInArrow(_place(cuts, per), f"k0 long, k1 long, k2 long, {where}")
    offsets, n = {}, 0
    for p, m in sorted((r["_part"], r["count"]) for r in narrow.groupBy("_part").count().collect()):  # a row for each part
        if offsets and p // per != max(offsets) // per:
            n = 0
        offsets[p] = n
        n += m
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = small_batches(rows).mapInArrow(_place(cuts, per), f"{shape}, {where}")
    moved = placed.repartitionById(shards * per, F.col("_part")).sortWithinPartitions(*KEYS)
    return moved.mapInArrow(_slots(offsets), f"{shape}, {where}, _slot long")


def _keys(id_col: str, text_col: str) -> list[F.Column]:
    """Equal texts stand next to each other; ids tell them apart where a boundary must fall among them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(id_col).cast("string")))
    return [F.xxhash64(text).alias("k0"), number.alias("k1"), (F.octet_length(text) + 1).cast("long").alias("size")]


def shard_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row; size is the text's UTF-8 bytes (null: none) plus 1.

    Shards are ranges of the text's hash, so equal texts stay together but where a boundary must fall among them; null
    and empty texts are equal; rows with null ids and repeated rows are told apart by their place in the input, which
    is fixed by a checkpoint. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = keep(docs.select(*_keys(id_col, text_col), F.monotonically_increasing_id().alias("k2"), F.col(id_col).alias("id"), F.crc32(text.cast("binary")).alias("text_crc32")))
    placed = histogram_shards(rows, shards=shards, tolerance=tolerance)
    return placed.select("id", "size", "text_crc32", F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """All rows and columns of `docs` with shard and slot added (replacing columns of those names).

    As shard_index, but rows that agree in all columns can't be told apart and stay in one part.
    """
    docs = docs.drop("shard", "slot")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    plain = docs.select(row.alias("row"), *_keys(id_col, text_col), F.xxhash64(*[F.to_json(row)]).alias("k2"))
    sizes = keep(plain.select(*KEYS, "size"))
    placed = histogram_shards(plain, sizes, shards, tolerance)
    return placed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
