"""Spelling variants: words one edit apart by a variable-length gram index, and the commoner spelling each leads to."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import keep, small_batches
from barwright.llm.tokens import LOWER, SPACE, Words, flat, slices

#: Lengths of grams. A word's longest are also at most half of it, so that two that do not overlap always fit in.
SHORTEST, LONGEST = 2, 6
#: Grams found more often than this are made longer; or than one in MOST_GRAMS of all, which bounds the dictionary.
RARE, MOST_GRAMS = 200, 200_000
#: Words longer than this have two grams, their halves.
LONG = 64
#: One word in so many is taken as misspelt by word_counts(..., noise=NOISE).
NOISE = 97

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LEAD = 0xC3  # the first byte of U+00C0 to U+00FF


def _runs(column: pa.Array) -> Words:
    """Runs of letters, A-Z in lower case, of each row."""
    data, off = flat(column)
    data = LOWER[data]
    lead = data == _LEAD
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    return Words(np.where(letter, data, 0x20).astype(np.uint8), off, SPACE)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None) -> DataFrame:
    """(word, n) of all runs of letters (A-Z, a-z, U+00C0 to U+00FF) in all texts, with A-Z in lower case.

    With `noise`, a run loses the code point CRC-32 % length wherever `noise` divides the CRC-32 of `<id>:<run>`; one of a
    single letter then counts for nothing. Counts are made up for each slice of texts before they are shuffled by word.
    Null texts have no words; a null id counts as empty text; repeated rows count as often as they are there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            words = _runs(b.column(b.schema.get_field_index("text")))
            code, vocabulary = words.encode()
            if not len(code):
                continue
            if noise is None:
                n, extra = np.bincount(code, minlength=len(vocabulary)), Counter()
            else:
                n, extra = _misspelt(b.column(b.schema.get_field_index("id")).to_pylist(), words.row_of, code, vocabulary, noise)
            some = np.flatnonzero(n)
            texts = [x.decode() for x in vocabulary.take(pa.array(some)).to_pylist()] + list(extra)
            yield pa.record_batch([pa.array(texts, pa.string()), pa.array([*n[some].tolist(), *extra.values()], pa.int64())], names=["word", "n"])

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    return small_batches(rows).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _misspelt(ids: list, row: np.ndarray, code: np.ndarray, vocabulary: pa.Array, noise: int) -> tuple[np.ndarray, Counter]:
    """How often each word stays as it is, and the words that come of the others."""
    pair, n = np.unique(row * len(vocabulary) + code, return_counts=True)
    row, code = np.divmod(pair, len(vocabulary))
    texts, begun = vocabulary.to_pylist(), [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    crc = np.fromiter((zlib.crc32(texts[c], begun[r]) for r, c in zip(row.tolist(), code.tolist(), strict=True)), np.int64, len(pair))
    hit = crc % noise == 0
    extra: Counter = Counter()
    for c, h, k in zip(code[hit].tolist(), crc[hit].tolist(), n[hit].tolist(), strict=True):
        word = texts[c].decode()
        at = h % len(word)
        if len(word) > 1:
            extra[word[:at] + word[at + 1 :]] += k
    return np.bincount(code[~hit], n[~hit], len(vocabulary)).astype(np.int64), extra


def dictionary(words: DataFrame) -> tuple[dict[str, int], int]:
    """Frequent grams of SHORTEST to LONGEST characters of the words between marks, with their counts; and the count that is frequent.

    At most MOST_GRAMS, whatever the words.
    """
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    of = lambda q: F.transform(F.sequence(F.lit(1), F.length("padded") - (q - 1)), lambda p: F.substring(F.col("padded"), p, F.lit(q)))
    short = words.where(F.length("word") <= LONG).select(padded.alias("padded"))
    grams = short.select(F.explode(F.flatten(F.array(*[F.when(F.length("padded") >= q, of(q)).otherwise(F.array().cast("array<string>")) for q in range(SHORTEST, LONGEST + 1)]))).alias("gram"))
    counted = keep(grams.groupBy("gram").agg(F.count("*").alias("n")))
    least = max(RARE, (counted.agg(F.sum("n")).first()[0] or 0) // MOST_GRAMS)
    return {r["gram"]: r["n"] for r in counted.where(F.col("n") > least).collect()}, least


def decomposed(word: str, size: int, frequent: dict[str, int], least: int) -> list[tuple[int, str, int]]:
    """(start, gram, about how many words have it) for each start in ^word$: as an index of words of `size` characters cuts it.

    The gram at a start is the shortest that is not frequent, or the longest allowed, or what is left of the word. It
    depends on its own characters alone, so one edit affects just the grams that hold the edited place.
    """
    text, longest = f"^{word}$", min(LONGEST, (size + 3) // 2)
    if size > LONG:
        half = size // 2
        return [(0, text[: half + 1], 0), (len(text) - (size + 1 - half), text[-(size + 1 - half) :], 0)]
    out = []
    for p in range(len(text) - SHORTEST + 1):
        q, n = SHORTEST, frequent.get(text[p : p + SHORTEST], 0)
        while n and q < longest and p + q < len(text):
            q += 1
            n = frequent.get(text[p : p + q], 0)
        out.append((p, text[p : p + q], n or least))
    return out


def _bound(starts: list[tuple[int, str, int]]) -> int:
    """How many of these grams one edit may affect: the most that hold one place."""
    edges = sorted([(p, 1) for p, _, _ in starts] + [(p + len(g), -1) for p, g, _ in starts])
    most = held = 0
    for _, step in edges:
        held += step
        most = max(most, held)
    return most


def _merged(word: str, size: int, frequent: dict[str, int], least: int) -> list[tuple[int, str]]:
    """(place in an indexed word of `size` characters, gram) of the lists to merge for a word, the shortest ones that will do.

    Lists will do if one edit can't affect all their grams: the bound of those grams is less than their number. Two
    grams that do not overlap are enough. Ahead of the edit places count from the start, behind it from the end: of a word
    one longer than the indexed ones the left gram is looked up where it is, the right one a place further left.
    """
    grams, best = decomposed(word, size, frequent, least), None
    shift = len(word) - size
    cheapest = [grams[-1]] * len(grams)  # of all from each on
    for k in range(len(grams) - 2, -1, -1):
        cheapest[k] = min(cheapest[k + 1], grams[k], key=lambda g: g[2])
    place = {p: k for k, (p, _, _) in enumerate(grams)}
    for a in grams:
        k = place.get(a[0] + len(a[1]), 1 if size > LONG and a is grams[0] else None)
        if k is not None and (best is None or a[2] + cheapest[k][2] < best[0]):
            best = (a[2] + cheapest[k][2], a, cheapest[k])
    _, a, b = best
    assert _bound([a, b]) < 2
    return [(a[0], a[1]), (b[0] - shift, b[1])]


def _lists(words: DataFrame, frequent: dict[str, int], least: int, probe: bool) -> DataFrame:
    """(key, word, n, letters) of all grams of each word; or for probe, of those that it looks up."""
    held = words.sparkSession.sparkContext.broadcast((frequent, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, least = held.value
        for b in batches:
            keys, at, letters = [], [], []
            texts = b.column(0).to_pylist()
            for row, word in enumerate(texts):
                own = len(word)
                if probe:
                    found = [(m, p, g) for m in (own, own - 1) if m > SHORTEST for p, g in _merged(word, m, frequent, least)]
                else:
                    found = [(own, p, g) for p, g, _ in decomposed(word, own, frequent, least)]
                keys += [zlib.crc32(f"{m} {p} {g}".encode()) for m, p, g in found]
                at += [row] * len(found)
                mark = 0
                for c in word:
                    mark |= 1 << (ord(c) & 63)
                letters += [mark - (1 << 64) if mark >> 63 else mark] * len(found)
            yield pa.record_batch([pa.array(keys, pa.int64()), b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(letters, pa.int64())], names=["key", "word", "n", "letters"])

    return small_batches(words.select("word", "n")).mapInArrow(run, "key long, word string, n long, letters long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of the words(word, n), all distinct, that differ by one inserted, deleted or replaced character, each pair once.

    Words are indexed under all grams of their decomposition with length and place; each looks up the two that it has to
    merge, among words of its own length and among those one shorter. Candidates are held to their sets of letters, then
    compared in the join itself, so only true pairs come out of it. A list is as long as its gram is frequent at that place
    of words of that length; long ones are split by skew handling of the join, and none is gathered in a row.
    """
    words = keep(words)
    frequent, least = dictionary(words)
    index = _lists(words, frequent, least, False).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("letters").alias("b_letters"))
    probes = _lists(words, frequent, least, True).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("a_letters"))
    once = (F.length("a") > F.length("b")) | (F.col("a") > F.col("b"))
    alike = F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2
    found = probes.join(index, (probes["key"] == index["key"]) & alike & once & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): forms followed to the last, twice as far in each round."""
    links = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = keep(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")))
        if links.where("went").isEmpty():
            return links.drop("went")


def variants(words: DataFrame, times: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words(word, n), all distinct: each with the commoner spelling that it leads to.

    Two words are near if one inserted, deleted or replaced character lies between them. A word's form is its near word of
    largest n, ties by code-point order, if that is at least `times` the word's own (above 1, so no forms go round); root is
    where the forms lead to. Words need at least three characters. An empty table gives no rows.
    """
    words = keep(words)
    if words.where(F.length("word") < 3).limit(1).count():
        raise ValueError("words need at least three characters")
    pairs = keep(near_pairs(words))
    sides = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    sides = sides.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = sides.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    leads = -F.col("best.less") >= F.lit(times) * F.col("n")
    best = keep(best.select("word", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")))
    out = words.join(best, "word", "left").join(_roots(best.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None, shortest: int = 5, least: int = 3) -> DataFrame:
    """variants() of the words of at least `shortest` characters found at least `least` times in all texts; see word_counts()."""
    counts = word_counts(docs, id_col, text_col, noise)
    return variants(counts.where((F.length("word") >= shortest) & (F.col("n") >= least)))
