import random

import pytest

from barwright.llm import decontaminate as dc
from barwright.llm import queries


def distance_within(pattern, text):
    """Fewest edits between the pattern and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_query(spark, sf_dir, texts):
    items = {r["item_id"]: dc.normalised(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(i, k) for i, t in texts.items() for k, p in items.items() if p in dc.normalised(t)}
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in queries.op9_decontaminate(spark, sf_dir).collect()}
    assert exact and {k for k, n in got.items() if n == 0} == exact
    for (i, k), n in got.items():
        assert n <= len(items[k]) // 10 and distance_within(items[k], dc.normalised(texts[i])) == n


@pytest.mark.parametrize("seed", range(4))
def test_all_texts_within_budget_are_found(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeth") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(rng.randrange(4, 40))) for _ in range(12)] + ["ab", "Zz top", "x" * 120]
    docs = []
    for i in range(60):
        own = bytearray(rng.choice(items).encode())
        for _ in range(rng.randrange(0, len(own) // 8 + 1)):
            at = rng.randrange(len(own))
            change = rng.randrange(3)
            if change == 0:
                own[at] = 97 + rng.randrange(26)
            elif change == 1:
                own.insert(at, 97 + rng.randrange(26))
            elif len(own) > 1:
                del own[at]
        edge = lambda: " ".join(word() for _ in range(rng.choice([0, 0, 5, 60])))
        docs.append((i, f"{edge()} {own.decode().upper() if i % 5 == 0 else own.decode()}, {edge()}"))
    want = {}
    for i, t in docs:
        for k, p in enumerate(items):
            p, text = dc.normalised(p), dc.normalised(t)
            n = distance_within(p, text) if len(p) >= dc.LEAST else 0 if p in text else 1
            if n <= (int(len(p) * dc.EDITS) if len(p) >= dc.LEAST else 0):
                want[i, k] = n
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (dc.BLOCK_BYTES, 200):
        got = {(r["id"], r["item_id"]): r["n_edits"] for r in dc.leaks(d, b, block_bytes=block).collect()}
        assert got == want
    kept = {r["doc_id"] for r in dc.clean(d, b, block_bytes=300).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_odd_rows(spark, odd_docs, clashing, empty_docs):
    b = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again"), (None, "two words"), (3, None), (4, ""), (5, "?!"), (6, "two words"), (7, "word " * 60)], "item_id long, text string")
    for df in (odd_docs, clashing):
        got = sorted(((r["id"], r["item_id"]) for r in dc.leaks(df, b).collect()), key=repr)
        assert got == sorted([(1, 1), (2, 1), (2, 1), (7, None), (7, 6), (9, 7)], key=repr)
        kept = dc.clean(df, b)
        assert kept.columns == df.columns and kept.count() == df.count() - 5
    assert dc.leaks(empty_docs, b).count() == 0 and dc.leaks(odd_docs, b.limit(0)).count() == 0
    assert dc.clean(odd_docs, b.limit(0)).count() == odd_docs.count()


def test_edits_count_characters(spark):
    """Three of 40 characters beyond ASCII: within the budget as characters, whatever they take in UTF-8."""
    item = "漢字仮名交じり文のかなり長い見本である文章をここに四十文字ほど並べて試すことにしようかな"
    assert len(item) == 44
    near = "".join("ß" if k in (5, 15, 25) else c for k, c in enumerate(item))
    far = "".join("ß" if k % 8 == 3 else c for k, c in enumerate(item))
    d = spark.createDataFrame([(1, "あいう" * 20 + near), (2, far), (3, item[:30]), (4, "x " + item)], "doc_id long, text string")
    got = sorted((r["id"], r["n_edits"], r["item_chars"]) for r in dc.leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect())
    assert got == [(1, 3, 44), (4, 0, 44)]


def test_large_numbers_are_sorted_by_their_parts(monkeypatch):
    items = [f"sentence number {k} of a benchmark that asks for something rather long" for k in range(20)]
    index = dc.Index(list(range(20)), items)
    texts = [f"before {items[k]} after" for k in range(20)]
    points, off = dc._points("".join(texts)), [0]
    for t in texts:
        off.append(off[-1] + len(t))
    import numpy as np

    want = index.candidates(points, np.array(off))

    class Many(list):
        def __len__(self):
            return 1 << 40

    index.texts = Many(index.texts)
    assert index.candidates(points, np.array(off)) == want and want
