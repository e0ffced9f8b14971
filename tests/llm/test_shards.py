import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barwright.llm import queries, shards


def check(rows, n, slack):
    """rows: (text, size, shard, slot)."""
    load, slots = Counter(), defaultdict(list)
    for _, size, shard, slot in rows:
        load[shard] += size
        slots[shard].append(slot)
    assert set(load) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, most = sum(load.values()), max((r[1] for r in rows), default=0)
    for s in range(n):
        assert abs(load[s] - total / n) <= slack * total / n + most
    return load


def test_query(spark, sf_dir, texts):
    rows = queries.op5_shards(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    check([(texts[r["doc_id"]], r["size"], r["shard"], r["slot"]) for r in rows], 8, 0.01)


@pytest.mark.parametrize("copies", [0, 700, 3000])
def test_hot_group(spark, copies):
    """Equal texts stay together but where their group alone is more than its share."""
    rng = random.Random(copies)
    rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(200)))) for i in range(2000)] + [(5000 + i, "a text with very many copies " * 4) for i in range(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [(r["id"], r["size"], r["shard"], r["slot"]) for r in shards.shard_index(df).collect()]
    check(got, 8, 0.02)
    of = defaultdict(set)
    text = dict(rows)
    for i, _, s, _ in got:
        of[text[i]].add(s)
    assert sum(len(s) > 1 for s in of.values()) <= 7
    again = shards.shard_index(df.repartition(3))
    assert {(r["id"], r["shard"], r["slot"]) for r in again.collect()} == {(i, s, k) for i, _, s, k in got}


def test_odd_rows(odd_docs, clashing, empty_docs):
    got = shards.shard_index(clashing, shards=3).collect()
    assert len(got) == odd_docs.count()
    check([(None, r["size"], r["shard"], r["slot"]) for r in got], 3, 1.0)
    whole = shards.shard(clashing, shards=3)
    assert [c for c in whole.columns if c not in ("shard", "slot")] == [c for c in clashing.columns if c not in ("shard", "slot")]
    assert whole.drop("shard", "slot").exceptAll(clashing.drop("shard", "slot")).count() == 0 and whole.count() == len(got)
    assert shards.shard_index(empty_docs).count() == 0 and shards.shard(empty_docs).count() == 0


def test_splitters_by_their_definition(spark):
    rng = random.Random(4)
    rows = [(rng.getrandbits(64) - (1 << 63), i, 0, rng.randrange(1, 100)) for i in range(3000)] + [(77, i, 0, 50) for i in range(2500)]
    df = spark.createDataFrame(rows, "k0 long, k1 long, k2 long, size long")
    cuts = shards.splitters(df, 10, 0.01)
    total = sum(r[3] for r in rows)
    for p, c in enumerate(cuts, 1):
        assert abs(sum(r[3] for r in rows if r[:3] < c) - p * total / 10) <= 0.01 * total / 10 + 100
    assert shards.splitters(df.limit(0), 4) == [((1 << 63) - 1,) * 3] * 3


def test_one_part_per_task(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    sizes = shards.shard(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 700
