import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barwright.llm import lines, queries

WHITE = " \t\n\r\x0b\x0c"


def brute(rows, least=10):
    """rows: (id, text); a repeated row is one document."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add((i, t or ""))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not key(x) or len(where[key(x)]) < least]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **how):
    kept = lines.apply_maps(df, lines.keep_maps(df, **how))
    return sorted(((r["id"], r["n_lines"], r["n_dropped"], lines.sha256_hex(r["kept_text"])) for r in kept.collect()), key=repr)


def test_query(spark, sf_dir, texts):
    got = queries.op3_lines(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got), key=repr) == brute(list(texts.items()))


def test_odd_rows(odd_docs, clashing, empty_docs):
    for df in (odd_docs, clashing):
        assert found(df, least_docs=2) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 2)
    assert found(empty_docs) == []


@pytest.mark.parametrize("parts", [1, 5, 37])
@pytest.mark.parametrize("batch", [3, 40, 10_000])
def test_hot_lines(spark, parts, batch):
    """A line in a third of all documents, lines in 9, 10 and 11 of them, over batches and partitions of any size."""
    rows = []
    for i in range(300):
        own = [f"own line {i}", f"own line {i}", ""]
        own += ["  Very COMMON line\t"] * (i % 3 == 0)
        own += [f"in {n} documents" for n in (9, 10, 11) if i % 25 == 0 and i // 25 < n] if i < 275 else []
        rows.append((i, "\n".join(own)))
    rows += rows[:4]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert found(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_maps_hold_bits_not_text(docs):
    m = lines.keep_maps(docs).agg(F.max(F.length("keep_map") - F.col("n_lines") / 8)).first()[0]
    assert m < 32
