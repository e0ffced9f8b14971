import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barwright.llm import licences, quality, queries
from barwright.llm.tokens import LOWER, PUNCT, SPACE, Words, flat, slices


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


SEPARATORS = [(SPACE, r"[^\x20\x09-\x0D]+"), (PUNCT, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


@pytest.mark.parametrize(("sep", "pattern"), SEPARATORS)
def test_words(texts, sep, pattern):
    rows = [*list(texts.values())[:50], "", None, " a", "b ", "c", "ÄÖ ü x\x85y\x1cz", "Æ-1.B"]
    for batch in slices(iter([pa.record_batch([pa.array(rows)], names=["text"]).slice(1)]), "text", 5000):
        data, off = flat(batch.column(0))
        w = Words(LOWER[data], off, sep)
        got = [x.decode() for x in w.array().to_pylist()]
        for i, t in enumerate(batch.column(0).to_pylist()):
            assert got[w.rows[i] : w.rows[i + 1]] == re.findall(pattern, lower(t))


# licences


def brute_base(text):
    words = re.findall(SEPARATORS[1][1], lower(text))
    at = [(k, label) for p, label in licences.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    labels = ",".join(sorted({x for _, x in at}))
    return len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), labels


def test_licence_query(spark, sf_dir, texts):
    rows = queries.op6_licences(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows} == {i: brute_base(t) for i, t in texts.items()}
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))


def test_licence_odd_rows(odd_docs, clashing, empty_docs):
    assert licences.scan(clashing).count() == odd_docs.count() and licences.scan(empty_docs).count() == 0


def test_matching_statistics():
    """The automaton's stream against all substrings."""
    rng = random.Random(1)
    for _ in range(40):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        automaton = licences.Automaton(sequences)
        words = [rng.randrange(4) for _ in range(60)]
        for i, (state, length) in enumerate(automaton.stream(words)):
            want = max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in runs), default=0)
            assert length == want
            for t, end in automaton.ends[state] if length else ():
                assert sequences[t][end - length + 1 : end + 1] == words[i + 1 - length : i + 1]
            if length:
                run = words[i + 1 - length : i + 1]
                assert {(t, e) for t, s in enumerate(sequences) for e in range(length - 1, len(s)) if s[e - length + 1 : e + 1] == run} == automaton.ends[state]


def test_templates_are_found_with_small_changes(spark):
    grant, notice = licences.TEMPLATES["mit"][0], licences.TEMPLATES["apache"][0]
    changed = grant.replace("obtaining a copy", "who obtains one copy").replace("free of charge", "at no charge at all")
    rows = [(1, "Some text. " + changed + " More."), (2, notice.upper() + " and " + grant), (3, " ".join(grant.split()[:8])), (4, "mit license Apache-License: the GENERAL public, license"), (5, "nothing of that kind"), (6, " ".join(random.Random(2).sample(grant.split(), 40)))]
    got = {r["id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(1, 7)] == ["mit", "apache,mit", "", "apache,gpl,mit", "", ""]
    assert got[2]["score"] == 1 and 0.6 <= got[1]["score"] < 1 and got[4]["n_base"] == 3
    assert got[1]["spans"][0]["first_word"] in (2, 17) and got[1]["spans"][0]["n_words"] > 30


# repetition


def brute_quality(text, least=quality.LEAST_REPEAT):
    words = re.findall(SEPARATORS[0][1], text or "")
    n = len(words)
    grams = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    inside = {i + j for i in range(n - 2) for j in range(3) if grams[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(SEPARATORS[0][1], line):
            dup += line in seen
            seen.add(line)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def brute_repeats(words, least):
    """Covered words and longest repeat, from all pairs of suffixes."""
    n, cover, longest = len(words), set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= least:
                cover |= {*range(i, i + k), *range(j, j + k)}
                longest = max(longest, k)
    return len(cover), longest


def test_quality_query(spark, sf_dir, texts):
    rows = queries.op7_repetition(spark, sf_dir).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in rows} == {i: brute_quality(t) for i, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in rows)


@pytest.mark.parametrize("least", [1, 2, 3, 5, 8])
def test_suffix_arrays(least):
    rng = random.Random(least)
    rows = [[rng.randrange(4) for _ in range(rng.randrange(40))] for _ in range(30)] + [[7] * 33, [], [1], list(range(30)) * 2]
    ids = np.array([x for r in rows for x in r], np.int64)
    cut = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    covered, longest = quality.repeats(ids, cut, least)
    assert list(zip(covered.tolist(), longest.tolist(), strict=True)) == [brute_repeats(r, least) for r in rows]


def test_quality_odd_rows(odd_docs, clashing, empty_docs):
    got = quality.measure(clashing).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted((brute_quality(r["text"]) for r in odd_docs.collect()), key=repr)
    assert quality.measure(empty_docs).count() == 0


def test_verdicts(spark):
    rng = random.Random(6)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = own(130)
    rows = [(1, own(400)), (2, own(900) + " " + passage + " " + own(500) + " " + passage), (3, own(100) + (" " + own(40)) + " tail " + own(30)), (4, " ".join([own(60)] * 2) + own(20))]
    got = {r["id"]: r for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert got[2]["longest_repeat"] == 130 and got[2]["covered_words"] == 260


def test_adjacent_licence_only_texts(spark):
    """Texts of template words alone, next to each other and to texts that begin and end with such words."""
    text = licences.TEMPLATES["cc-by"][0]
    rows = [(i, text) for i in range(5)] + [(5, "the work"), (6, None), (7, text), (8, "this"), (9, "zebra"), (10, text)]
    got = {r["id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    for i, t in rows:
        assert (got[i]["labels"], got[i]["score"]) == (("cc-by", 1.0) if t == text else ("", 0.0)), i


def licence_labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["id"]: r for r in licences.scan(df).collect()}


def test_whole_licence_texts(spark):
    """Each text, commented out and re-wrapped within other words, gets its label and a span that covers it."""
    labels = sorted(licences.TEXTS)
    texts = ["int main(); " * 30 + "\n".join(f" * {line.strip()}" for line in licences.TEXTS[x][0].splitlines()).upper() + " return value; " * 30 for x in labels]
    got = licence_labels(spark, texts)
    kin = {"agpl": {"gpl"}, "lgpl": {"gpl"}}  # their notices hold most of the other's words, and its name
    for i, label in enumerate(labels):
        assert {label} <= set(got[i]["labels"].split(",")) <= {label} | kin.get(label, set())
        assert got[i]["score"] == 1.0 and any(s["label"] == label and s["n_words"] == len(licences.words_of(licences.TEXTS[label][0])) for s in got[i]["spans"])


def test_parts_of_licence_texts(spark):
    words = licences.TEXTS["zlib"][0].split()
    most, little, changed = words[: int(0.7 * len(words))], words[: int(0.4 * len(words))], [w if i % 20 else "altered" for i, w in enumerate(words)]
    got = licence_labels(spark, [" ".join(x) for x in (most, little, changed)])
    assert [got[i]["labels"] for i in range(3)] == ["zlib", "", "zlib"]


def test_chains_against_all_predecessors():
    """Repetitive templates and texts, whose matches have many predecessors."""
    rng = random.Random(8)
    for _ in range(30):
        templates = {f"t{k}": [" ".join(rng.choice("ab") + str(rng.randrange(2)) for _ in range(60))] for k in range(2)}
        scanner = licences.Scanner(templates, {})
        words = [rng.randrange(len(scanner.vocabulary)) for _ in range(150)]
        seen, found = list(scanner.automaton.stream(words)), {}
        for i, (state, n) in enumerate(seen):
            if n >= licences.LEAST_MATCH and (i + 1 == len(seen) or seen[i + 1][1] <= n):
                for t, end in scanner.automaton.ends[state]:
                    found.setdefault(t, []).append((i - n + 1, end - n + 1, n))
        want = {}
        for t, matches in found.items():
            matches.sort()
            cover = []
            for k, (a, b, n) in enumerate(matches):
                best = n
                for j in range(k):
                    e, f = matches[j][0] + matches[j][2], matches[j][1] + matches[j][2]
                    over = max(0, e - a, f - b)
                    if over < n and a + over - e in range(licences.MOST_GAP + 1) and b + over - f in range(licences.MOST_GAP + 1):
                        best = max(best, cover[j] + n - over)
                cover.append(best)
            if max(cover) >= licences.LEAST_COVER * 60:
                want[t] = max(cover)
        assert {t: c for t, _, c in scanner.spans(words)} == want


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_repeats_longer_than_the_kept_ranks(monkeypatch, levels):
    monkeypatch.setattr(quality, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [[rng.randrange(3) for _ in range(rng.randrange(0, 60))] for _ in range(20)] + [[0] * 70, list(range(40)) * 2]
    ids, cut = np.array([x for r in rows for x in r]), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    covered, longest = quality.repeats(ids, cut, 4)
    assert list(zip(covered.tolist(), longest.tolist(), strict=True)) == [brute_repeats(r, 4) for r in rows]


def test_share_allowed_falls_with_length(spark):
    """Two copies of one passage: 36 % of a short text and of a long one."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(n, f"{words('p', n * 18 // 100)} {words('x', n * 64 // 100)} {words('p', n * 18 // 100)}") for n in (100, 600)]
    got = {r["id"]: (r["kept"], r["base_failed"]) for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100: (True, False), 600: (False, False)}
