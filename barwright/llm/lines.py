"""Line deduplication: hashed lines in range partitions, read as sorted streams, give a keep bitmap per document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_CHARS = 1
LEAST_DOCS = 10
_STRIP = b" \t\n\r\x0b\x0c"
_SHAPE = "part int, h1 long, h2 long, known boolean, id {kind}, mark long, n_lines long, places binary"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: white space stripped at both ends, A-Z in lower case. Null and empty texts are one empty line."""
    return [line.strip(_STRIP) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def mark_of(i, text: str | None) -> int:
    """A signed 64-bit hash of a document's id and text."""
    return xxhash.xxh64_intdigest(b"%s\0%s" % (str(i).encode(), (text or "").encode("utf-8", "surrogatepass")), 7) - (1 << 63)


def _hashed(kind: str, parts: int, least_docs: int, least_chars: int):
    """A row for each document and distinct line key; keys that one batch alone shows to be common are settled in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            docs: dict[tuple, int] = {}
            where: dict[bytes, dict[int, list[int]]] = {}
            size, marks, first = [], [], []
            for row, (i, text) in enumerate(zip(ids.to_pylist(), texts, strict=True)):
                mark = mark_of(i, text)
                if (i, mark) in docs:
                    continue
                docs[i, mark] = doc = len(first)
                keys = line_keys(text)
                size.append(len(keys))
                marks.append(mark)
                first.append(row)
                for place, key in enumerate(keys):
                    if len(key) >= least_chars and (least_chars <= 1 or len(key.decode("utf-8", "replace")) >= least_chars):
                        where.setdefault(key, {}).setdefault(doc, []).append(place)
            settled: dict[int, list[int]] = {}
            h1, h2, doc, places, known = [], [], [], [], []
            for key, found in where.items():
                digest = xxhash.xxh3_128_intdigest(key)
                a, c = (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)
                if len(found) >= least_docs:
                    # Common within this batch: its own documents are settled here. One vote for the key, worth
                    # `least_docs` documents, stands for them all.
                    for d, at in found.items():
                        settled.setdefault(d, []).extend(at)
                    h1.append(a), h2.append(c), doc.append(-1), places.append(b""), known.append(False)
                    continue
                for d, at in found.items():
                    h1.append(a), h2.append(c), doc.append(d), places.append(np.array(at, "<i4").tobytes()), known.append(False)
            for d in range(len(first)):
                h1.append(marks[d]), h2.append(0), doc.append(d), known.append(True)
                places.append(np.array(settled.get(d, ()), "<i4").tobytes())
            at = np.array(doc, np.int64)
            rows = pa.array(np.array([*first, 0])[at], mask=at < 0)
            h = np.array(h1, np.int64)
            part = ((h.astype(np.float64) + 2.0**63) / 2.0**64 * parts).astype(np.int32).clip(0, parts - 1)
            yield pa.record_batch(
                [pa.array(part), pa.array(h), pa.array(h2, pa.int64()), pa.array(known, pa.bool_()), ids.take(rows), pa.array(np.array([*marks, 0], np.int64)[at]), pa.array(np.array([*size, 0], np.int64)[at]), pa.array(places, pa.binary())],
                names=[x.split()[0] for x in _SHAPE.split(", ")],
            )

    return run


def _dropped(least_docs: int):
    """From rows sorted by key, document and place: the places of keys found in at least `least_docs` documents.

    A key's rows are held back only until it has that many documents; then they, and all that follow, pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = 0, None  # documents of the key so far, and its rows that still wait
        last = mark = None
        for b in batches:
            h1, h2 = (b.column(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2"))
            known = b.column("known").to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (known[1:] != known[:-1]))))
            end = np.append(begin[1:], len(h1))
            n_lines = b.column("n_lines").to_numpy(zero_copy_only=False)
            # A row is one document's, or, with no lines, a vote. A document that is repeated counts once.
            marks = b.column("mark").to_numpy(zero_copy_only=False)
            same = np.concatenate(([marks[0] == mark and (h1[0], h2[0], known[0]) == last], marks[1:] == marks[:-1]))
            same[begin[1:]] = False
            mark = marks[-1]
            worth = np.where(n_lines == 0, least_docs, ~same)
            total = np.add.reduceat(worth, begin)
            take = np.zeros(len(h1), bool)
            for k, (lo, hi) in enumerate(zip(begin, end, strict=True)) if len(begin) < 3 else [(0, (begin[0], end[0])), (len(begin) - 1, (begin[-1], end[-1]))]:
                key = (h1[lo], h2[lo], known[lo])
                if k == 0 and key == last:
                    cut += total[k]
                else:
                    cut, held, last = total[k], [], key
                if known[lo] or cut >= least_docs:
                    yield from held or ()
                    held = []
                    take[lo:hi] = True
                else:
                    held.append(b.slice(lo, hi - lo))
            inner = np.flatnonzero((total >= least_docs) | known[begin])
            inner = inner[(inner > 0) & (inner < len(begin) - 1)]
            size = np.diff(np.append(begin, len(h1)))
            flags = np.zeros(len(begin), bool)
            flags[inner] = True
            take |= np.repeat(flags, size)
            take &= n_lines > 0
            if take.any():
                yield b.filter(pa.array(take))

    return lambda batches: (b.filter(pa.array(b.column("n_lines").to_numpy(zero_copy_only=False) > 0)).select(["id", "mark", "n_lines", "places"]) for b in run(batches))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, gone = [], []
        for n, places in zip(b.column("n_lines").to_pylist(), b.column("places").to_pylist(), strict=True):
            drop = np.zeros(n, bool)
            for p in places:
                drop[np.frombuffer(p, "<i4")] = True
            maps.append(zlib.compress(np.packbits(~drop).tobytes(), 6))
            gone.append(int(drop.sum()))
        yield pa.record_batch([b.column("id"), b.column("mark"), b.column("n_lines"), pa.array(gone, pa.int64()), pa.array(maps, pa.binary())], names=["id", "mark", "n_lines", "n_dropped", "keep_map"])


def keep_maps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, mark, n_lines, n_dropped, keep_map): which lines of each document stay, as a zlib-compressed bitmap.

    A line goes, in every document, if its key (see line_keys) has at least `least_chars` code points and is found in at
    least `least_docs` documents. `mark` is a hash of id and text: a document is an (id, text), so rows that repeat both
    are one document and have one bitmap; null ids are told apart by their texts. An empty table gives no rows.

    Keys are 128-bit hashes. Their rows go to equal ranges of the hash space and are sorted there by key and document;
    each range is read as a stream that holds at most `least_docs` documents' places of one key. A key that is common in
    one batch of documents is settled in that batch and sends one vote, so that no key has more than `least_docs` rows a
    batch however many rows hold it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_hashed(kind, parts, least_docs, least_chars), _SHAPE.format(kind=kind))
    ranged = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("known", "h1", "h2", "id", "mark")
    gone = ranged.mapInArrow(_dropped(least_docs), f"id {kind}, mark long, n_lines long, places binary")
    per_doc = gone.groupBy("id", "mark").agg(F.max("n_lines").alias("n_lines"), F.collect_list("places").alias("places"))
    return per_doc.mapInArrow(_bitmaps, f"id {kind}, mark long, n_lines long, n_dropped long, keep_map binary")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = [mark_of(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(marks, pa.int64())], names=["id", "text", "mark"])


def apply_map(text: str | None, keep_map: bytes, n_lines: int) -> str:
    """The lines of a text that its bitmap keeps, joined by line breaks."""
    kept = np.unpackbits(np.frombuffer(zlib.decompress(keep_map), np.uint8), count=n_lines)
    return "\n".join(line for line, k in zip((text or "").split("\n"), kept, strict=True) if k)


def apply_maps(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_text) for each row of `docs`."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_marked, f"id {kind}, text string, mark long")
    m = maps.select(F.col("id").alias("m_id"), F.col("mark").alias("m_mark"), "n_lines", "n_dropped", "keep_map")
    both = rows.join(m.hint("shuffle_hash"), rows["id"].eqNullSafe(m["m_id"]) & (rows["mark"] == m["m_mark"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [apply_map(t, k, n) for t, k, n in zip(*(b.column(c).to_pylist() for c in ("text", "keep_map", "n_lines")), strict=True)]
            yield pa.record_batch([b.column("id"), b.column("n_lines"), b.column("n_dropped"), pa.array(text, pa.string())], names=["id", "n_lines", "n_dropped", "kept_text"])

    return both.select("id", "text", "n_lines", "n_dropped", "keep_map").mapInArrow(run, f"id {kind}, n_lines long, n_dropped long, kept_text string")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
