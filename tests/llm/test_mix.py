import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barwright.llm import mix, queries


def brute_targets(sizes):
    """sizes by source; sources by code point, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        if not left:
            return full
        rest = budget - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return {**full, **share}
        full.update({s: 2.0 * sizes[s] for s in over})


def check(got, rows):
    """rows: (id, source, text)."""
    sizes, most = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        most[s] = max(most[s], n)
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert len(got) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * max(most.values()) + 1
    assert sum(taken.values()) <= sum(want.values()) + 1e-6


def test_query(spark, sf_dir, docs):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    one = queries.op10_mix(spark, sf_dir).collect()
    check(one, rows)
    assert sorted(one) == sorted(queries.op10_mix(spark, sf_dir).collect())


def test_odd_rows(odd_docs, clashing, empty_docs):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in odd_docs.collect()]
    for df in (odd_docs, clashing):
        got = mix.mix(df).collect()
        check(got, rows)
        assert mix.apply(df).count() == sum(r["copies"] for r in got)
        assert mix.apply(df).columns == df.columns
    assert mix.mix(empty_docs).count() == 0 and mix.apply(empty_docs).count() == 0


def test_hot_source_in_any_partitioning(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    one = mix.mix(df.repartition(2)).collect()
    check(one, [(r["doc_id"], r["source"], r["text"]) for r in df.collect()])
    assert sorted(one, key=repr) == sorted(mix.mix(df.repartition(9)).collect(), key=repr)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op10_mix(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
