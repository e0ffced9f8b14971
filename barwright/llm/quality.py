"""Quality rules on repetition: suffix arrays of word sequences and their longest-common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import small_batches
from barwright.llm.tokens import LEAD, SPACE, Words, flat, slices

#: A repeat counts from so many words on.
LEAST_REPEAT = 8
#: A text fails if repeats cover more than this share of its words, or one repeat has more than so many words. A line
#: that is said twice weighs more in a short text: the share allowed falls from MOST_COVERED + EXTRA, at EXTRA_WORDS words
#: or fewer, towards MOST_COVERED in proportion to 1 / words.
MOST_COVERED = 0.25
EXTRA, EXTRA_WORDS = 0.15, 100
MOST_LENGTH = 120
LEAST_WORDS = 50
#: Ranks of this many doublings are kept to read common prefixes from, with 4 bytes a word each.
LEVELS = 13
MOST_PERCENT = 50
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _rank(key: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers, in the order of the keys."""
    order = np.argsort(key, kind="stable")
    out = np.empty(len(key), np.int64)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    out[order] = np.cumsum(new) - 1
    return out


def repeats(ids: np.ndarray, rows: np.ndarray, least: int = LEAST_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """For each row of words: how many words lie in substrings of `least` or more words that the row holds twice, and the longest such.

    Suffixes are ranked by prefix doubling within each row. Rows in which all runs of `least` words differ are done after
    the first doublings; the suffixes of the others are ranked to the end. Neighbours in the suffix array share their
    longest common prefix, read off the ranks of the doublings up to 4,096 words, of which the highest is applied as often as it holds; each suffix's longest prefix shared with a neighbour is
    the longest repeat that begins there, so these spans have the same union as all maximal repeats.
    """
    n_rows, n = len(rows) - 1, len(ids)
    covered, longest = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    if not n:
        return covered, longest
    row = np.repeat(np.arange(n_rows), np.diff(rows))
    left = rows[row + 1] - np.arange(n)  # words up to the row's end

    def doubled(rank: np.ndarray, span: int, left: np.ndarray) -> np.ndarray:
        after = np.zeros(len(rank), np.int64)
        ok = left > span
        after[ok] = rank[np.flatnonzero(ok) + span] + 1
        return _rank(rank * (len(rank) + 1) + after)

    def runs_of(rank: np.ndarray, span: int, width: int, left: np.ndarray) -> np.ndarray:
        """Number of the run of `width` words, span <= width <= 2 * span, from each place; places too near the end get -1."""
        ok = left >= width
        key = rank * (len(rank) + 1) + np.where(ok, rank[np.minimum(np.arange(len(rank)) + width - span, len(rank) - 1)], 0)
        return np.where(ok, _rank(key), -1)

    rank, span = _rank(row * (int(ids.max()) + 1) + ids), 1
    while 2 * span < least:
        rank, span = doubled(rank, span, left), 2 * span
    run = runs_of(rank, span, least, left) if least > 1 else rank
    held = run >= 0
    twice = np.zeros(n, bool)
    twice[held] = np.bincount(run[held])[run[held]] > 1
    hot = np.zeros(n_rows, bool)
    hot[row[twice]] = True
    if not hot.any():
        return covered, longest
    # The rows with repeats, by themselves.
    of = np.flatnonzero(hot)
    take = hot[row]
    row = np.searchsorted(of, row[take])
    ids, left = ids[take], left[take]
    n = len(ids)
    rank, span = _rank(row * (int(ids.max()) + 1) + ids), 1
    levels = [rank.astype(np.int32)]
    while rank.max() < n - 1:
        rank, span = doubled(rank, span, left), 2 * span
        if len(levels) < LEVELS:
            levels.append(rank.astype(np.int32))
    order = np.argsort(rank, kind="stable")
    del rank
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    open_ = np.flatnonzero(row[a] == row[b])
    for k in range(len(levels) - 1, -1, -1):
        at = open_
        while len(at):
            x, y = a[at] + common[at], b[at] + common[at]
            at = at[(left[a[at]] - common[at] >= 1 << k) & (left[b[at]] - common[at] >= 1 << k) & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])]
            common[at] += 1 << k
            if k < len(levels) - 1:  # below the highest level a second step can't fit
                break
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    best[best < least] = 0
    reach = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(best)
    np.add.at(reach, at, 1)
    np.add.at(reach, at + best[at], -1)
    inside = np.cumsum(reach[:-1]) > 0
    covered[of] = np.bincount(row, inside, len(of)).astype(np.int64)
    np.maximum.at(longest, of[row], best)
    return covered, longest


def _repeated_words(ids: np.ndarray, rows: np.ndarray, width: int = 3) -> np.ndarray:
    """For each row, the words that lie in windows of `width` words found twice or more in it."""
    n_rows, n = len(rows) - 1, len(ids)
    row = np.repeat(np.arange(n_rows), np.diff(rows))
    if n < width:
        return np.zeros(n_rows, np.int64)
    top = int(ids.max()) + 1
    two = _rank(ids[:-1] * top + ids[1:])
    three = _rank(two[:-1] * top + ids[2:])
    ok = row[: n - width + 1] == row[width - 1 :]
    key = np.where(ok, row[: n - width + 1] * (int(three.max()) + 1) + three, -1)
    number = _rank(key)
    hit = ok & (np.bincount(number)[number] > 1)
    inside = np.zeros(n, bool)
    for j in range(width):
        inside[j : n - width + 1 + j] |= hit
    return np.bincount(row, inside, n_rows).astype(np.int64)


def _repeated_lines(text: str | None) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        if line.split(None, 1):
            again += line in seen
            seen.add(line)
    return again


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_repeat: int = LEAST_REPEAT, most_covered: float = MOST_COVERED, most_length: int = MOST_LENGTH) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat, base_failed, kept) for each row.

    covered_words lie in substrings of at least `least_repeat` words that the text holds twice or more, and
    longest_repeat is the longest one's length in words. A text that passes the base rules is kept if covered_words is at
    most `most_covered` + EXTRA x min(1, EXTRA_WORDS / words) of its words and longest_repeat at most `most_length`.

    Null and empty texts have no words and fail; repeated rows and null ids are returned as they are; an empty table
    gives no rows; other columns are ignored. The longest text is measured whole, in about
    130 bytes of memory a word.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 3 << 20):
            data, off = flat(b.column(1))
            w = Words(data, off, SPACE)
            ids, _ = w.encode()
            n = np.diff(w.rows)
            total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[off])
            chars = total(LEAD[data] & ~SPACE[data])
            symbols = total(_SYMBOL[data])
            lines = np.fromiter(map(_repeated_lines, b.column(1).to_pylist()), np.int64, b.num_rows)
            windows = _repeated_words(ids, w.rows)
            covered, longest = repeats(ids, w.rows, least_repeat)
            failed = (n < LEAST_WORDS) | (100 * windows > MOST_PERCENT * n)
            kept = ~failed & (covered <= (most_covered + EXTRA * np.minimum(1, EXTRA_WORDS / np.maximum(n, 1))) * n) & (longest <= most_length)
            columns = [n, chars, symbols, lines, windows, covered, longest, failed, kept]
            yield pa.record_batch([b.column(0), *map(pa.array, columns)], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "base_failed", "kept"])

    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"))
    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {counts}, base_failed boolean, kept boolean")
