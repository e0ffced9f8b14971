import math
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash

from barwright.llm import queries, toxicity


def test_query_on_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    caught = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert np.mean(caught) > 0.8 and np.mean(clean) < 0.02


def test_only_texts_count(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one = toxicity.learn(docs, labels)
    shown = toxicity.scored(docs.withColumn("score", docs["doc_id"]), one)
    assert shown.columns.count("score") == 1 and shown.count() == docs.count()
    two = toxicity.learn(docs.repartition(3), labels.repartition(2))
    assert np.allclose(one.weights, two.weights) and one.bias == two.bias


def test_odd_rows(spark, odd_docs, clashing, empty_docs):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, None, 1), (1, 0, 0), (2, 0, 0), (6, 0, 0), (None, 1, 1), (7, 1, None), (99, 0, 1)], schema)
    for docs in (odd_docs, clashing, empty_docs):
        for marks in (labels, labels.limit(0)):
            got = toxicity.scored(docs, toxicity.learn(docs, marks)).collect()
            assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    bare = toxicity.learn(empty_docs, labels.limit(0))
    assert np.allclose(toxicity.probability(np.array([bare.bias])), toxicity.PRIOR)


def test_features():
    f = toxicity.Features(pa.array(["Scum, scum", "", None, "scum other"]))
    sets = [set(f.feature[f.row == r].tolist()) for r in range(4)]
    assert len(sets[0]) == 3 and sets[0] < sets[3] and not sets[1] and not sets[2]


def told_apart(positive, unlabelled):
    shares = toxicity.Shares()
    for toxic, docs in ((1, positive), (0, unlabelled)):
        for d in docs:
            shares.add(toxic, d)
    return shares.telling()


def test_features_and_choice_against_brute_force():
    """Words and their 5-grams by plain string work; shares of distinct texts by counting."""
    texts = ["Scum of the earth", "scum!", "the quiet river, the boat", "the quiet river, the boat", "earth and Ünï 漢字", ""] * 2
    gram = lambda g: int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 % 2**64 >> 64 - toxicity.BITS
    whole = lambda w: xxhash.xxh64_intdigest(w) >> 64 - toxicity.BITS
    want = []
    for t in texts:
        own = set()
        for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower()):
            marked = b"\x01" + w + b"\x02"
            own |= {whole(w)} | {gram(marked[k : k + 5].ljust(5, b"\0")) for k in range(max(1, len(marked) - 4))}
        want.append(own)
    f = toxicity.Features(pa.array(texts))
    assert [set(f.feature[f.row == r].tolist()) for r in range(len(texts))] == want
    rng = np.random.default_rng(2)
    positive = [np.unique(rng.integers(0, 60, 12)).astype("<i4") for _ in range(80)]
    unlabelled = [np.unique(rng.integers(20, 200, 12)).astype("<i4") for _ in range(300)] * 2
    used = told_apart(positive, unlabelled)
    p, u = ({d.tobytes(): set(d.tolist()) for d in docs}.values() for docs in (positive, unlabelled))
    for x in range(200):
        a, b = (sum(x in d for d in docs) for docs in (p, u))
        both = (a + b + 1) / (len(p) + len(u) + 2)
        z = (a / len(p) - b / len(u)) / (both * (1 - both) * (1 / len(p) + 1 / len(u))) ** 0.5
        assert used[x] == (z >= 4 and a / len(p) >= 3 * b / len(u))


def brute_fit(positive, unlabelled, prior, epochs, seed=1):
    """The same risk, written down for one text and one weight at a time."""
    rng = np.random.default_rng(seed)
    w, m, v = {}, {}, {}
    b, bm, bv, t = math.log(prior / (1 - prior)), 0.0, 0.0, 0
    n_p, n_u = min(len(positive), toxicity.BATCH // 3), min(len(unlabelled), toxicity.BATCH - min(len(positive), toxicity.BATCH // 3))
    for _ in range(epochs):
        orders = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(-(-max(len(positive) // n_p, len(unlabelled) // n_u))):
            docs = [positive[orders[0][i % len(positive)]] for i in range(k * n_p, (k + 1) * n_p)] + [unlabelled[orders[1][i % len(unlabelled)]] for i in range(k * n_u, (k + 1) * n_u)]
            p = [1 / (1 + math.exp(-(b + sum(w.get(x, 0.0) for x in d)))) for d in docs]
            negative = sum(p[n_p:]) / n_u - prior * sum(p[:n_p]) / n_p
            grad, gb = {}, 0.0
            for i, d in enumerate(docs):
                g = p[i] * (1 - p[i]) * ((-2 * prior / n_p if i < n_p else 1 / n_u) if negative >= 0 else (-prior / n_p if i < n_p else 0.0))
                gb += g
                for x in d:
                    grad[x] = grad.get(x, 0.0) + g
            t += 1
            rate = toxicity.RATE * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for x, g in grad.items():
                g += toxicity.DECAY * w.get(x, 0.0)
                m[x], v[x] = 0.9 * m.get(x, 0.0) + 0.1 * g, 0.999 * v.get(x, 0.0) + 0.001 * g * g
                w[x] = w.get(x, 0.0) - rate * m[x] / (math.sqrt(v[x]) + 1e-8)
            bm, bv = 0.9 * bm + 0.1 * gb, 0.999 * bv + 0.001 * gb * gb
            b -= rate * bm / (math.sqrt(bv) + 1e-8)
    return w, b


def test_fit_against_brute_force():
    rng = np.random.default_rng(4)
    positive = [np.unique(rng.integers(0, 30, 6)) for _ in range(130)]
    unlabelled = [np.unique(rng.integers(10, 80, 6)) for _ in range(420)]
    model = toxicity.fit(positive, unlabelled, 0.2, epochs=4)
    w, b = brute_fit([d.tolist() for d in positive], [d.tolist() for d in unlabelled], 0.2, 4)
    assert abs(model.bias - b) < 1e-9 and all(abs(model.weights[x] - y) < 1e-9 for x, y in w.items()) and not model.weights[80:].any()


def test_scores_against_brute_force(spark):
    """learn() and scored() over a small table: the drawn texts, their prior and every score."""
    rows = [(i, ("vile scum " if i % 4 == 0 else "kind words ") + f"about item {i} and more " * 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    marked = [i for i in train if i % 2 == 0]
    assert model.prior == sum(i % 4 == 0 for i in marked) / len(marked)
    f = toxicity.Features(pa.array([t for _, t in rows]))
    margin = model.bias + np.array([model.weights[f.feature[f.row == r]].sum() for r in range(400)])
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert np.allclose([got[i] for i in range(400)], 1 / (1 + np.exp(-margin)), atol=1e-5)
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400))


def test_risk_with_positives_among_the_unlabelled():
    """Half of the unlabelled positives carry only one of the telling words."""
    rng = np.random.default_rng(0)
    noise = lambda: rng.choice(5000, 40, replace=False) + 1000
    positive = [np.unique(np.append(noise(), [1, 2, 3][: rng.integers(1, 4)])).astype("<i4") for _ in range(400)]
    unlabelled = [np.unique(np.append(noise(), [1]) if k % 10 == 0 else noise()).astype("<i4") for k in range(3000)]
    used = told_apart(positive, unlabelled)
    m = toxicity.fit([d[used[d]] for d in positive], [d[used[d]] for d in unlabelled], 0.1)
    margin = lambda d: m.bias + m.weights[d].sum()
    assert np.mean([margin(np.append(noise(), [1])) > 0 for _ in range(200)]) > 0.95
    assert np.mean([margin(noise()) > 0 for _ in range(200)]) < 0.02
