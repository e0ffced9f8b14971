"""Benchmark decontamination: q-gram counts in diagonal bands, and banded alignment of the regions that pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import small_batches
from barwright.llm.tokens import LEAD, LOWER, PUNCT, SMALL_SLICE, flat, slices

Q = 8
#: Edits allowed, as a share of a benchmark text's length. The lemma needs it below 1 / Q.
EDITS = 0.1
#: Shorter benchmark texts (normalised) must be found whole, without edits.
LEAST = 40
#: Benchmark text is searched in blocks of about so many characters; each block is one pass over the documents.
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 22
_HASH = np.uint64(0x9E3779B97F4A7C15)


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of the rows with A-Z in lower case and each run of other ASCII but digits as one space."""
    data, off = flat(column)
    data = LOWER[data]
    gap = PUNCT[data]
    data[gap] = 32
    drop = np.zeros(len(data), bool)
    drop[1:] = gap[1:] & gap[:-1]
    starts = off[:-1][off[:-1] < len(data)]
    drop[starts] = gap[starts]
    kept = ~drop
    before = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))
    return data[kept], before[off]


def normalised(text: str | None) -> str:
    data, _ = normalise(pa.array([text or ""], pa.string()))
    return data.tobytes().decode("utf-8", "surrogatepass").rstrip(" ")


def _points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each place; equal hashes are verified like any candidate."""
    n = max(len(points) - Q + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(Q):
        out *= np.uint64(0x100000001B3)
        out += points[j : j + n]
    return out * _HASH


def edit_distance(pattern: str, text: str, low: int, high: int, budget: int) -> tuple[int, int]:
    """Fewest edits between the whole pattern and a stretch of text on diagonals low - budget to high + budget, and its end.

    (budget + 1, -1) if no alignment in that band is within budget.
    """
    a, b = _points(pattern), _points(text)
    first, width = low - budget, high - low + 2 * budget + 1
    far = budget + 1
    # Column j of the band in row i stands for text place i + first + j.
    place = first + np.arange(width)
    cost = np.where((place >= 0) & (place <= len(b)), 0, far)
    steps = np.arange(width)
    for i in range(len(a)):
        at = i + place
        ok = (at >= 0) & (at < len(b))
        same = np.zeros(width, bool)
        same[ok] = b[at[ok]] == a[i]
        across = np.where(ok, cost + ~same, far)
        down = np.append(cost[1:], far) + 1  # a pattern character left out
        cost = np.minimum(across, down)
        cost = np.minimum.accumulate(cost - steps) + steps  # text characters left out
        cost[(i + 1 + place < 0) | (i + 1 + place > len(b))] = far
        if cost.min() > budget:
            return far, -1
    best = int(cost.argmin())
    return int(cost[best]), len(a) + first + best


class Index:
    """Q-grams of a block of benchmark texts."""

    def __init__(self, ids: list, texts: list[str], edits: float = EDITS):
        self.ids, self.texts = ids, texts
        size = np.array([len(t) for t in texts], np.int64)
        self.budget = np.where(size >= LEAST, (size * edits).astype(np.int64), 0)
        self.need = np.maximum(size + 1 - Q * (self.budget + 1), 1)
        self.band = self.budget + 1
        grams = [_grams(_points(t)) for t in texts]
        value = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(value, kind="stable")
        self.item, self.place = item[order], place[order]
        self.value, self.first = np.unique(value[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(value)))
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[self.value >> np.uint64(64 - _TABLE_BITS)] = True
        self.short = [k for k in range(len(texts)) if 0 < size[k] < Q]

    def candidates(self, points: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, lowest and highest start) of the bands that hold as many common q-grams as the lemma asks for."""
        grams = _grams(points)
        at = np.flatnonzero(self.seen[grams >> np.uint64(64 - _TABLE_BITS)])
        value = grams[at]
        slot = np.minimum(np.searchsorted(self.value, value), max(len(self.value) - 1, 0))
        ok = self.value[slot] == value if len(self.value) else np.zeros(0, bool)
        at, slot = at[ok], slot[ok]
        row = np.searchsorted(off, at, "right") - 1
        ok = at + Q <= off[row + 1]
        at, slot, row = at[ok], slot[ok], row[ok]
        if not len(at):
            return []
        n = self.count[slot]
        post = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, place = self.item[post], self.place[post]
        # Rows stand so far apart that no two share a diagonal. Diagonals of one alignment lie within the budget of each
        # other, so two neighbouring cells of budget + 1 hold them all; a place of the pattern counts once a cell.
        shift = max(map(len, self.texts)) + 1
        apart = off[:-1] + shift * np.arange(1, len(off))
        cell = (np.repeat(at + shift * (row + 1), n) - place) // self.band[item]
        top = (len(points) + shift * (len(off) + 1)) + 1
        key = item * top + cell
        if len(self.texts) * top * shift < 1 << 62:
            both = np.sort(key * shift + place)
            key = both[np.concatenate(([True], both[1:] != both[:-1]))] // shift
        else:  # too large for one number
            order = np.lexsort((place, key))
            key, place = key[order], place[order]
            key = key[np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])))]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(begin, len(key)))
        key = key[begin]
        both = count.copy()
        both[:-1] += np.where(key[1:] == key[:-1] + 1, count[1:], 0)
        item, cell = key // top, key % top
        hit = np.flatnonzero(both >= self.need[item])
        item, low, size = item[hit], cell[hit] * self.band[item[hit]], self.band[item[hit]]
        row = np.maximum(np.searchsorted(apart, low + 2 * size - 1, "right") - 1, 0)
        near = np.maximum(np.searchsorted(apart, low + shift, "right") - 1, 0)  # a start before the row's own
        out = []
        for k in np.argsort(-both[hit], kind="stable").tolist():
            for r in range(int(row[k]), int(near[k]) + 1):
                first = int(low[k] - apart[r])
                out.append((r, int(item[k]), first, first + 2 * int(size[k]) - 1))
        return out

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start band's low end, end, edits): the best alignment within budget of each row and item, if any."""
        data, off = normalise(column)
        whole = data.tobytes().decode("utf-8", "surrogatepass")
        off = np.concatenate(([0], np.cumsum(LEAD[data])))[off]  # from bytes to characters
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, low, high in self.candidates(_points(whole), off):
            text = whole[off[row] : off[row + 1]]
            pattern, budget = self.texts[item], int(self.budget[item])
            held = best.get((row, item))
            if held and held[0] == 0:
                continue
            at = text.find(pattern, max(low, 0), max(high, 0) + len(pattern))
            edits, end = (0, at + len(pattern)) if at >= 0 else edit_distance(pattern, text, low, high, budget) if budget else (1, -1)
            if edits <= budget and (not held or (edits, end) < held[:2]):
                best[row, item] = (edits, end, end - len(pattern) if at >= 0 else max(low, 0))
        for item in self.short:
            at = whole.find(self.texts[item])
            while at >= 0:
                row = int(np.searchsorted(off, at, "right")) - 1
                if at + len(self.texts[item]) <= off[row + 1]:
                    best.setdefault((row, item), (0, at + len(self.texts[item]) - int(off[row]), at - int(off[row])))
                at = whole.find(self.texts[item], at + 1)
        for (row, item), (edits, end, low) in sorted(best.items()):
            yield row, item, low, end, edits


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, edits: float, block_bytes: int) -> Iterator[Broadcast]:
    """Indexes of blocks of benchmark texts, in order of their ids, each broadcast: the driver holds one block at a time."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([normalised(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    send = benchmark.sparkSession.sparkContext.broadcast
    kind = benchmark.schema[item_col].dataType.simpleString()
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(plain, f"id {kind}, text string")
    for r in rows.where("text <> ''").orderBy("id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
        if size >= block_bytes:
            yield send(Index(ids, texts, edits))
            ids, texts, size = [], [], 0
    if ids:
        yield send(Index(ids, texts, edits))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, n_edits, item_chars, found_end) for each row of `docs` and each benchmark text that it holds.

    Texts are compared in lower case (A-Z), with every run of ASCII characters other than letters and digits as one
    space; lengths, q-grams and edits are of characters. A benchmark text of length m counts as held if some stretch of the
    document is within e = edits x m edits of it; one shorter than 40 must be held exactly. Such a stretch shares at
    least m + 1 - q(e + 1) q-grams with it, on diagonals at most e apart, so every pair of neighbouring cells of e + 1
    diagonals is counted, the pairs that reach the bound are kept, and each is verified by an alignment in that band.
    n_edits is the fewest edits found.

    Null and empty texts hold nothing; benchmark texts without letters or digits are skipped; repeated rows and null ids
    are searched as they are; an empty table on either side gives no rows; other columns are ignored. The benchmark is
    searched in blocks of about `block_bytes` characters, each broadcast as one index and a pass over the documents.
    """
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, id_col), (benchmark, item_col)))
    shape = f"id {kind}, item_id {item_kind}, n_edits long, item_chars long, found_end long"
    picked = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for index in _indexes(benchmark, item_col, item_text_col, edits, block_bytes):
        found = picked.mapInArrow(_finder(index, benchmark.schema[item_col].dataType), shape)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], shape)


def _finder(held: Broadcast, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for b in slices(batches, "text", SMALL_SLICE):
            rows = list(index.search(b.column(1)))
            if rows:
                row, item, _, end, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array([index.ids[i] for i in item], item_arrow), pa.array(n), pa.array([len(index.texts[i]) for i in item], pa.int64()), pa.array(end)], names=["id", "item_id", "n_edits", "item_chars", "found_end"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark text (see leaks). No row is shuffled.

    Null and empty texts hold none and stay, as do repeated rows and rows with null ids; an empty table gives no rows, an
    empty benchmark all of them; any columns are kept as they are.
    """
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for index in _indexes(benchmark, item_col, item_text_col, edits, block_bytes):
        docs = small_batches(docs).mapInArrow(_dropper(index, text_col), shape)
    return docs


def _dropper(held: Broadcast, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for b in slices(batches, text_col, SMALL_SLICE):
            keep = np.ones(b.num_rows, bool)
            keep[[row for row, *_ in index.search(b.column(b.schema.get_field_index(text_col)))]] = False
            yield b.filter(pa.array(keep))

    return run
