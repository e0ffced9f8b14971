import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barwright.llm import queries, setjoin, simhash
from barwright.llm.common import components, join_by_key, keep


def brute_fingerprint(text, shingle=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] if len(words) >= shingle else [words]
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(fps, radius=2):
    """fps: (id, fingerprint) rows -> component of each row."""
    at = list(range(len(fps)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
            at[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(fps):
        r = root(i)
        if doc is not None:
            low[r] = min(low.get(r, doc), doc)
    return [low.get(root(i)) for i in range(len(fps))]


def test_fingerprints(texts):
    for t in [*list(texts.values())[:60], "", None, "x", "a b", "A B c\x0bd\x1ce \x85f"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_query(spark, sf_dir, texts):
    rows = [(i, brute_fingerprint(t)) for i, t in texts.items()]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("bucket", [2, 13, 1024])
def test_links_in_dense_clusters(spark, bucket):
    """Clusters of fingerprints a few bits around centres: small, large and overflowing buckets link the same."""
    rng = random.Random(bucket)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4]))))
    fps = sorted(fps)
    rows = [(x, x) for x in fps]
    want = brute_components(rows)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df, 2, bucket)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    got = [root.get(s, s) for s in signed]
    pairs = lambda x: {(i, j) for i, j in combinations(range(len(x)), 2) if x[i] == x[j]}
    assert pairs(got) == pairs(want)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    at = {}
    find = lambda x: x if at.setdefault(x, x) == x else find(at[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        at[y] = x
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, clashing, empty_docs):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in odd_docs.collect()]
    want = sorted(zip([r[0] for r in rows], [r[1] for r in rows], brute_components(rows), strict=True), key=repr)
    for df in (odd_docs, clashing):
        got = [(r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(df).collect()]
        assert sorted(got, key=repr) == want
    assert simhash.near_groups(empty_docs).count() == 0 and simhash.keep_one(empty_docs).count() == 0


@pytest.mark.parametrize("how", [{}, {"similarity": 0.8, "shingle": 5}])
def test_keep_one(odd_docs, clashing, how):
    kept = simhash.keep_one(clashing, **how)
    assert kept.columns == clashing.columns
    rows = [(r["doc_id"], (r["text"] or "").strip().lower()) for r in kept.collect()]
    assert len({t for _, t in rows}) == len(rows)  # no text twice; one of all empty ones
    every = {(r["text"] or "").strip().lower() for r in odd_docs.collect()}
    assert {t for _, t in rows} == every
    assert (1, "the quick brown fox jumps over the lazy dog again and again") in rows
    assert all(i == 3 for i, t in rows if t == "")


def set_groups(df):
    of, _ = simhash._groups(df, "doc_id", "text", 5, 2, 1024, 0.8)
    return {r["id"]: r["component_id"] for r in setjoin.set_fingerprints(df, "doc_id", "text", 5).join(of, "fp").collect()}


def test_similarity_groups(spark):
    """Near copies at 0.8 or more are grouped, those well below and unrelated texts are not."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, family = [], {}
    for f in range(60):
        base = [word() for _ in range(400)]
        for k in range(4):
            own = list(base)
            for at in rng.sample(range(400), k * 2):
                own[at] = word()
            family[len(rows)] = f
            rows.append((len(rows), " ".join(own)))
        far = list(base)
        for at in range(0, 400, 8):  # every window of five words is likely changed
            far[at] = word()
        family[len(rows)] = -len(rows)
        rows.append((len(rows), " ".join(far)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    comp = set_groups(df)
    wrong = [(i, j) for i, j in combinations(range(len(rows)), 2) if comp[i] == comp[j] and family[i] != family[j]]
    lost = [i for i in comp if family[i] >= 0 and comp[i] != min(j for j in family if family[j] == family[i])]
    assert not wrong and not lost


def test_hot_group_of_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "the same text in very many rows").otherwise(F.concat_ws(" ", F.lit("text"), F.md5(F.col("id").cast("string")), F.sha1(F.col("id").cast("string")), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = simhash.near_groups(df).groupBy("component_id").count().orderBy(F.desc("count")).first()
    assert (got["component_id"], got["count"]) == (0, 1500)
    kept = simhash.keep_one(df, shingle=5, similarity=0.8).select("doc_id").orderBy("doc_id").collect()
    assert [r[0] for r in kept] == [0, *range(1500, 3000)]


def test_frequent_keys_are_broadcast(spark):
    rows = keep(spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1000)], "k long, x long"))
    by_key = keep(rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("s")))
    joined = join_by_key(rows, by_key, "k", "n")
    assert sorted(joined.select("k", "x", "s").collect()) == sorted(rows.join(by_key, "k").select("k", "x", "s").collect())


def test_components_of_stars_and_chains(spark):
    """A hub with the largest and one with the smallest number, joined by a chain."""
    edges = [(10_000, i) for i in range(1, 900)] + [(0, 20_000 + i) for i in range(900)] + [(20_000, 30_000), (30_000, 30_001), (30_001, 10_000)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({x for e in edges for x in e}) and {r["root"] for r in got} == {0}


def brute_groups(texts, similarity=0.8):
    """Component of each text by the exact Jaccard similarity of five-word shingle sets."""
    vocabulary, sets = {}, []
    for t in texts:
        w = t.split()
        sets.append(np.array(sorted({vocabulary.setdefault(tuple(w[i : i + 5]), len(vocabulary)) for i in range(len(w) - 4)})))
    size = np.array([len(s) for s in sets])
    row, code = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    root = np.arange(len(sets))
    for i, own in enumerate(sets):
        mark = np.zeros(len(vocabulary), bool)
        mark[own] = True
        both = np.bincount(row[mark[code]], minlength=len(sets))
        near = np.unique(root[both >= similarity * (size + size[i] - both) - 1e-9])
        root[np.isin(root, near)] = near[0]
    return root


def families(seed, n, words, changes):
    """n texts with some words of one base changed, each in its own places."""
    rng = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.choice(changes)):
            own[at] = f"c{seed}x{i}x{at}"
        out.append(" ".join(own))
    return out


def found_groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    comp = set_groups(df)
    return np.array([comp[i] for i in range(len(texts))])


def test_large_family_is_linked_whole(spark):
    """Thousands of different texts about one base, many of them similar to few others only."""
    texts = families(1, 3000, 120, [1, 2, 3, 4, 5]) + families(2, 40, 120, [0, 1, 2])
    assert (found_groups(spark, texts) == brute_groups(texts)).all()


def test_threshold_is_exact(spark):
    """Pairs around a similarity of 0.8 are linked as their sets say: 0.8 itself is in."""
    texts = []
    for f in range(150):
        base = [f"w{f}x{i}" for i in range(94)]  # 90 shingles
        texts.append(" ".join(base))
        cut = 6 + f % 8  # a changed tail of 6 to 13 words: similarities of 0.87 to 0.75, at 10 words 80 / 100
        texts.append(" ".join(base[: 94 - cut] + [f"c{f}x{i}" for i in range(cut)]))
    for f in range(50):
        base = [f"y{f}x{i}" for i in range(104)]  # 100 shingles, the other has 80 of them
        texts += [" ".join(base), " ".join(base[:84])]
    want = brute_groups(texts)
    assert (want[300::2] == want[301::2]).all() and (want[:300:2] != want[1:300:2]).any()
    assert (found_groups(spark, texts) == want).all()


def test_pairs_in_one_run(spark):
    """2,000 pairs of near copies that all share one passage, and 400 pairs of templated texts: none is lost."""
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(40)]
    texts = []
    for f in range(2000):
        own = [f"w{f}x{i}" for i in range(30)]
        texts += [" ".join(shared + own), " ".join(shared + own[:-1] + [f"c{f}"])]
    for f in range(400):
        base = [f"t{i}" if rng.random() < 0.95 else f"p{f}x{i}" for i in range(200)]
        other = list(base)
        other[rng.randrange(100)] = f"q{f}"
        texts += [" ".join(base), " ".join(other)]
    assert (found_groups(spark, texts) == brute_groups(texts)).all()


def test_long_texts(spark):
    """Sets of thousands of shingles are held apart by larger bitmaps and linked at 0.8."""
    texts = []
    for f in range(30):
        base = [f"w{f}x{i}" if i % 2 else f"s{i}" for i in range(6000)]
        near = [f"c{f}x{i}" if i < 600 else w for i, w in enumerate(base)]
        far = [f"d{f}x{i}" if i < 900 else w for i, w in enumerate(base)]
        texts += [" ".join(base), " ".join(near), " ".join(far)]
    want = brute_groups(texts)
    assert (found_groups(spark, texts) == want).all() and (want[0::3] == want[1::3]).all() and (want[0::3] != want[2::3]).any()


def brute_set_simhash(text):
    """SimHash of the distinct five-word shingles, each counted once."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words] * bool(words)
    h = {xxhash.xxh64_intdigest(" ".join(r).encode(), seed=42) for r in runs}
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_near_duplicates_come_from_simhash_links(spark, sf_dir, texts, monkeypatch):
    """The pipeline's stage links the fingerprints of its sets by their bits, before any other link is looked for."""
    import corpus_pipeline

    seen, links = [], simhash.links

    def spied(fps, *how):
        seen.append(({r["fp"] % (1 << 64) for r in fps.collect()}, how))
        return links(fps, *how)

    monkeypatch.setattr(simhash, "links", spied)
    corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).count()
    assert seen == [({brute_set_simhash(t) for t in texts.values()}, (simhash.RADIUS, simhash.BUCKET))]


def test_sets_of_near_fingerprints(spark):
    """Sets that share a fingerprint, hundreds of them too, and sets a few bits apart are linked as brute force links them."""
    rng = random.Random(11)
    bits = [rng.getrandbits(64) for _ in range(300)] + [7] * 400
    bits += [b ^ sum(1 << x for x in rng.sample(range(64), rng.choice([0, 1, 2, 3]))) for b in bits[:350]]
    rows = list(enumerate(bits))
    want = brute_components(rows)
    df = spark.createDataFrame([(i, b - (1 << 64) if b >> 63 else b) for i, b in rows], "fp long, bits long")
    found = simhash.near_sets(df).collect()
    assert all(r["a"] < r["b"] and (want[r["a"]] == want[r["b"]]) for r in found)
    root = {r["node"]: r["root"] for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert [root.get(i, i) for i, _ in rows] == want


@pytest.mark.parametrize("how", ["none", "chain", "right"])
def test_sets_decide_links_of_bits(spark, how):
    """Whatever pairs the bits give, false ones too, only similar sets are linked and all of them are."""
    texts = families(4, 60, 100, [1, 2, 3]) + families(5, 20, 100, [0, 1]) + [f"own{i} of its kind alone {i} a{i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low = {r["fp"]: r["id"] for r in setjoin.set_fingerprints(df, "doc_id", "text", 5).orderBy(F.desc("id")).collect()}
    want, fps = brute_groups(texts), sorted(low)
    pairs = {"none": [], "chain": list(zip(fps, fps[1:], strict=False)), "right": [(a, b) for a, b in combinations(fps, 2) if want[low[a]] == want[low[b]]]}[how]
    of, edges = setjoin.similar_groups(df, "doc_id", "text", 5, 0.8, lambda sets: spark.createDataFrame(pairs, "a long, b long"))
    assert {r["fp"]: r["low"] for r in of.collect()} == low
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    got = {f: root.get(f, f) for f in fps}
    assert all((got[a] == got[b]) == (want[low[a]] == want[low[b]]) for a, b in combinations(fps, 2))
