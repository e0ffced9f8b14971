"""The pipeline's stages, each held against its own input."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barwright.llm import decontaminate as dc
from barwright.llm import mix, queries, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    base, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(base / str(k)))
        docs = spark.read.parquet(str(base / str(k)))
        out.append([r.asDict() for r in docs.collect()])
    return [[r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()], *out]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]


def test_toxicity(spark, sf_dir, stages):
    before, after = stages[0], stages[1]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = toxicity.scored(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in scores.where("score < 0.5").collect())
    assert len(after) < len(before)


def test_one_of_each_group_stays(stages):
    before, after = stages[1], stages[2]
    kept = {r["doc_id"]: shingles(r["text"]) for r in after}
    similar = lambda a, b: len(a & b) / len(a | b)
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    names = sorted(kept)
    close = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if similar(kept[a], kept[b]) >= 0.8]
    assert not close
    for i in set(sets) - set(kept):  # whatever went has a near copy in the input, under a smaller id or through others
        assert max(similar(sets[i], s) for j, s in sets.items() if j != i) >= 0.8


def test_leaks_go(spark, sf_dir, stages):
    items = [dc.normalised(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in stages[2]} - {r["doc_id"] for r in stages[3]}
    assert not any(p in dc.normalised(r["text"]) for r in stages[3] for p in items)
    exact = {r["doc_id"] for r in stages[2] if any(p in dc.normalised(r["text"]) for p in items)}
    assert exact <= gone


def test_mixing(spark, stages):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    want = {r["id"]: r["copies"] for r in mix.mix(spark.createDataFrame(stages[3], schema)).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in stages[4]) == want


def test_sharding(stages):
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    slots, load = defaultdict(list), Counter()
    for r in stages[5]:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += len((r["text"] or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(r["shard"] for r in stages[5]) <= set(range(8))


def test_columns(stages):
    assert all(list(rows[0]) == list(stages[0][0]) for rows in stages[1:5] if rows)


def test_run(spark, sf_dir, stages):
    got = sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted((r["doc_id"], r["shard"], r["slot"]) for r in stages[5])


def test_odd_rows_go_through_all_stages(spark, sf_dir, clashing, empty_docs, tmp_path):
    """Null ids and texts, repeated rows, long texts and clashing names; and an empty table."""
    for name, docs in (("odd", clashing.withColumn("_toxicity", F.lit("own")).withColumn("_copies", F.lit(1))), ("none", empty_docs)):
        path = str(tmp_path / name)
        docs.write.parquet(f"{path}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
        got = corpus_pipeline.run(spark, path)
        assert [c for c in got.columns if c not in ("shard", "slot")] == [c for c in docs.columns if c not in ("shard", "slot")]
        texts = Counter(r["text"] for r in got.collect())
        if name == "none":
            assert not texts
        else:
            assert set(map(tuple, got.select("_toxicity", "_copies").distinct().collect())) == {("own", 1)}
            assert sum("quick brown fox" in t.lower() for t in texts) == 1 and all(n <= 2 and t.strip() for t, n in texts.items())


def test_sql_twins(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        want = sorted((dict(zip(columns, r, strict=True)) for r in cursor.fetchall()), key=lambda r: r[columns[0]])
        got = sorted((r.asDict() for r in queries.queries()[name](spark, sf_dir).collect()), key=lambda r: r[columns[0]])
        assert got == want
