import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import queries, spelling
from tests.test_queries import compare, duck  # noqa: F401

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(rows, noise=None):
    out = Counter()
    for r in rows:
        for run in RUN.findall(r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if run:
                out[run] += 1
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + (len(a) > len(b)) :] == b[k + (len(b) > len(a)) :]


def brute(n):
    sides = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if near(a, b):
            sides[a].append(b)
            sides[b].append(a)
    form = {}
    for w, others in sides.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(sides[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def table(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def test_query_against_sql(spark, duck, sf_dir):  # noqa: F811
    compare(spark, duck, sf_dir, queries.op13_spelling, queries.oracle_sql()["op13_spelling"])


def test_query_against_brute_force(spark, sf_dir, docs):
    n = counts([r.asDict() for r in docs.collect()], spelling.NOISE)
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    assert len(n) > 1000
    assert rows_of(queries.op13_spelling(spark, sf_dir)) == brute(n)


@pytest.mark.parametrize("rare", [1, 5, 200])
def test_crowded_words(spark, monkeypatch, rare):
    """Words of few letters, so that most have many near ones and the dictionary goes to all its lengths; accents, and chains of forms."""
    monkeypatch.setattr(spelling, "RARE", rare)
    rng = np.random.default_rng(rare)
    words = {"".join(rng.choice(list("abÿé"), rng.integers(3, 11))) for _ in range(900)} | {"a" * k for k in range(3, 20)} | {"ab" * k for k in range(2, 9)}
    n = {w: int(k) for w, k in zip(sorted(words), rng.integers(1, 400, len(words)), strict=True)}
    assert rows_of(spelling.variants(table(spark, n))) == brute(n)


def test_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 12)
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdef"), k)) for k in (10, 11, 12, 13, 14, 40, 300) for _ in range(12)]
    words = set(base)
    for w in base:
        for _ in range(6):
            k = int(rng.integers(0, len(w)))
            words.add(w[:k] + w[k + 1 :] if rng.random() < 0.5 else w[:k] + "z" + w[k + int(rng.random() < 0.5) :])
    n = {w: int(k) for w, k in zip(sorted(words), rng.integers(1, 99, len(words)), strict=True)}
    assert rows_of(spelling.variants(table(spark, n))) == brute(n)
    assert any(r[4] for r in brute(n) if len(r[0]) > 200)


def test_bounds_of_affected_grams():
    """One edit changes no gram that does not hold the edited place, and at most as many as the bound says."""
    frequent = {"^a": 900, "ab": 900, "abc": 700, "bc": 500, "c$": 300}
    for word in ("abcabc", "cabbage", "aaaaa", "abcdefgh"):
        grams = spelling.decomposed(word, len(word), frequent, 200)
        for k in range(len(word)):
            other = word[:k] + "z" + word[k + 1 :]
            kept = set(grams) & set(spelling.decomposed(other, len(word), frequent, 200))
            held = {g for g in grams if g[0] <= k + 1 < g[0] + len(g[1])}
            assert set(grams) - held <= kept and len(held) <= spelling._bound(grams)


def test_counts(spark, odd_docs, clashing, docs):
    rows = [r.asDict() for r in odd_docs.collect()] + [r.asDict() for r in docs.limit(40).collect()]
    df = odd_docs.unionByName(docs.limit(40))
    for noise in (None, 2, 97):
        got = {r["word"]: r["n"] for r in spelling.word_counts(df, noise=noise).collect()}
        assert got == dict(counts(rows, noise))
    assert {r["word"]: r["n"] for r in spelling.word_counts(clashing).collect()} == dict(counts([r.asDict() for r in odd_docs.collect()]))


def test_odd_rows(spark, odd_docs, clashing, empty_docs):
    n = {w: k for w, k in counts([r.asDict() for r in odd_docs.collect()]).items() if len(w) >= 3 and k >= 1}
    for df in (odd_docs, clashing):
        assert rows_of(spelling.group(df, shortest=3, least=1)) == brute(n)
    assert spelling.group(empty_docs).count() == 0
    with pytest.raises(ValueError, match="three"):
        spelling.variants(table(spark, {"ab": 3}))
    assert spelling.variants(table(spark, {"Straße": 3})).select(F.col("root")).first()[0] == "Straße"
