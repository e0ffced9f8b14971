import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barwright.llm import lm, queries


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def fold(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7


def brute(rows, weights):
    """The base score by its formula, and the model's score with weights given."""
    one, two, ctx, starts = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if fold(i) != 2:
            w = tokens(t)
            one.update(w)
            two.update(zip(["<s>", *w[:-1]], w, strict=True))
            ctx.update(["<s>", *w[:-1]])
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for h, x in zip(["<s>", *w[:-1]], w, strict=True):
            base += math.log10((one[x] + 1) / (n + v + 1))
            b = 0 if not ctx[h] else min(math.ceil(math.log2(ctx[h])) + 1, lm.BUCKETS - 1)
            l2, l1, l0 = weights[b]
            score += math.log10(l2 * two[h, x] / max(ctx[h], 1) + l1 * one[x] / max(n, 1) + l0 / (v + 1))
        out.append((i, fold(i) == 2, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return sorted(out, key=repr)


def same(got, want):
    got = sorted((tuple(r) for r in got), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_scores(docs, texts):
    got, model = lm.score(docs)
    same(got.collect(), brute(list(texts.items()), model.weights))
    assert np.allclose(model.weights.sum(1), 1) and (model.weights[:, 2] > 0).all()


def test_query_beats_the_base_on_held_out_texts(spark, sf_dir):
    rows = [r for r in queries.op4_lm(spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


@pytest.mark.parametrize("size", [1, 3000, 8 << 20])
def test_blocks_and_groups_change_nothing(docs, texts, monkeypatch, size):
    monkeypatch.setattr(lm, "BLOCK_BYTES", size)
    monkeypatch.setattr(lm, "GROUP_KEYS", 5000)
    few = docs.where("doc_id < 25")
    got, model = lm.score(few)
    same(got.collect(), brute([(i, t) for i, t in texts.items() if i < 25], model.weights))


@pytest.mark.parametrize("size", [1, 3000])
def test_parts_of_ranges_change_nothing(docs, texts, monkeypatch, size):
    monkeypatch.setattr(lm, "BLOCK_BYTES", size)
    monkeypatch.setattr(lm, "GROUP_KEYS", 900)
    monkeypatch.setattr(lm, "RANGES", 3)
    few = docs.where("doc_id < 25")
    got, model = lm.score(few)
    same(got.collect(), brute([(i, t) for i, t in texts.items() if i < 25], model.weights))


def test_rows_asked_grow_with_the_input(docs, monkeypatch):
    """Rows between the steps for 1, 2 and 4 times the blocks, beyond the ranges that a block may have."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1)
    monkeypatch.setattr(lm, "RANGES", 8)
    monkeypatch.setattr(lm, "GROUP_KEYS", 400)
    made = []
    keep, inner = lm.stash, []
    monkeypatch.setattr(lm, "stash", lambda df, name: inner.append(name) or made.append((name, (out := keep(df, name)).count())) or out)
    sizes = []
    for n in (25, 50, 100):
        made.clear()
        lm.score(docs.where(f"doc_id < {n}"))[0].count()
        sizes.append({name: rows for name, rows in made})
    assert all({"lm-asked", "lm-parts"} <= set(s) for s in sizes)
    for name in ("lm-asked", "lm-parts", "lm-counts"):
        assert sizes[2][name] <= 4.6 * sizes[0][name], (name, sizes)


def test_text_ids(spark):
    df = spark.createDataFrame([(f"d{i}", f"some text {i}") for i in range(20)], "doc_id string, text string")
    got, model = lm.score(df)
    same(got.collect(), brute([(f"d{i}", f"some text {i}") for i in range(20)], model.weights))


def test_odd_rows(odd_docs, clashing, empty_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for df in (odd_docs, clashing):
        got, model = lm.score(df)
        same(got.collect(), brute(rows, model.weights))
    assert lm.score(empty_docs)[0].count() == 0


def test_em_finds_the_better_component():
    half = lm._BINS // 2
    cells = [(5, half + 160, half + 16, 900), (5, -1, half + 16, 100), (9, -1, half + 160, 1000)]
    w = lm.learn_weights(cells)
    assert w[5].argmax() == 0 and 0.85 < w[5, 0] < 0.95 and w[9].argmax() == 1
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0
