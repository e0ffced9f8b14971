import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from barwright.llm import merkle, queries
from tests.test_queries import compare, duck  # noqa: F401


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(r, text=None):
    return h(*[field(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"] if text is None else text)])


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append("".join(run[: at % 8] + run[at % 8 + 1 :]))
        at //= 8
    return out


def refold(digest, tree, at):
    for level in tree[:-1]:
        run = list(level[at // 8 * 8 : at // 8 * 8 + 8])
        run[at % 8] = digest
        digest, at = h(*run), at // 8
    return digest


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r["lang"] is not None, (r["lang"] or "").encode()), []).append(r)
    first = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))
    names = sorted(groups)
    trees = {g: levels([leaf_of(r) for r in sorted(groups[g], key=first)]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, r in enumerate(sorted(groups[g], key=first)):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]) if changed else None
            back = refold(refold(leaf_of(r, lower), trees[g], i), top, j)
            proof = h(*siblings(trees[g], i), *siblings(top, j))
            out.append((str(r["doc_id"]), leaf_of(r), trees[g][-1][0], top[-1][0], proof, back, back == top[-1][0]))
    return sorted(out)


def tried(docs):
    proof = F.sha2(F.concat_ws("", F.transform("proof", lambda s: s["siblings"])), 256).alias("proof")
    got = merkle.audited(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0).select("id", "leaf", "subroot", "root", proof, "folded_root", "verified")
    return sorted((str(r["id"]), *tuple(r)[1:]) for r in got.collect())


def test_query_against_sql(spark, duck, sf_dir):  # noqa: F811
    compare(spark, duck, sf_dir, queries.op12_merkle, queries.oracle_sql()["op12_merkle"])


def test_query_against_brute_force(spark, sf_dir, docs):
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in queries.op12_merkle(spark, sf_dir).collect())
    assert got == brute([r.asDict() for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [1] * 9 + [65], [512, 8, 7], [73] * 10])
def test_shapes(spark, sizes):
    """Lone leaves, full and broken runs, and so many groups that the upper tree has levels too."""
    rows = [{"doc_id": 1000 * g + 7 * k % n, "text": f"Text {k}", "lang": f"l{g}" if g else None, "source": "s", "n_chars": k} for g, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert tried(df) == brute(rows)


def test_odd_rows(odd_docs, clashing, empty_docs):
    want = brute([r.asDict() for r in odd_docs.collect()])
    assert tried(odd_docs) == want == tried(clashing)
    assert merkle.audited(empty_docs, F.lit(True)).count() == 0


def test_requests(spark, docs, tmp_path):
    """Proofs of some leaves are those that all leaves get; another leaf than the manifest's doesn't lead to the root."""
    rows = docs.select("lang", F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    every = {r["id"]: r for r in merkle.prove(rows, "lang", ["id"]).collect()}
    asked = spark.createDataFrame([("=en", 0), ("=en", 17), ("=en", 18), ("=fr", 3), ("=fr", 10**6), ("=fr", 3)], "g string, i long")
    some = merkle.prove(rows, "lang", ["id"], path=str(tmp_path / "m"), asked=asked)
    got = {r["id"]: r for r in some.collect()}
    en, fr = (sorted(r["id"] for r in docs.where(F.col("lang") == x).collect() for r in [{"id": r["doc_id"]}]) for x in ("en", "fr"))
    assert set(got) == {en[0], en[17], en[18], fr[3]}
    assert all(tuple(got[k]) == tuple(every[k]) for k in got)
    forged = some.select(merkle.folded(F.lit("0" * 64), F.col("proof")).alias("x"), merkle.folded(F.col("leaf"), F.col("proof")).alias("y"), "root").collect()
    assert all(r["x"] != r["root"] == r["y"] for r in forged)
