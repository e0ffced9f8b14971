"""Words of Arrow string columns as flat buffers: numpy passes over the column's bytes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CODES = np.arange(256)
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)
#: The bytes that end a word: ASCII white space.
SPACE = (_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D))
#: All ASCII but 0-9 and a-z: for texts that are lower-cased already.
PUNCT = (_CODES < 0x80) & ~((_CODES >= 0x30) & (_CODES <= 0x39)) & ~((_CODES >= 0x61) & (_CODES <= 0x7A))
#: UTF-8 bytes that begin a code point.
LEAD = (_CODES & 0xC0) != 0x80

SLICE_BYTES = 6 << 20
#: For work that takes many times a text's size in memory.
SMALL_SLICE = 512 << 10


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the rows' offsets in them; a null row is an empty one."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts hold about so many bytes (a longer row stands alone)."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        _, off = flat(batch.column(at))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


class Words:
    """Words of some rows: `packed` bytes of all words, `off` their offsets, `rows` the first word of each row (and the end)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, sep: np.ndarray):
        kept = ~sep[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        begins, ends = kept & edge[:-1], kept & edge[1:]
        begins[1:] |= kept[1:] & ~kept[:-1]
        ends[:-1] |= kept[:-1] & ~kept[1:]
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(ends) + 1
        self.packed = data[kept]
        self.off = np.concatenate(([0], np.cumsum(self.stop - self.start)))
        self.rows = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.off.astype(np.int32)), pa.py_buffer(self.packed)])

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words by number."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def crc32_of(ids: pa.Array) -> np.ndarray:
    """CRC-32 of each id as text; a null id counts as empty text."""
    import zlib

    return np.fromiter((0 if i is None else zlib.crc32(str(i).encode()) for i in ids.to_pylist()), np.int64, len(ids))
