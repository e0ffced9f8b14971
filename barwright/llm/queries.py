"""The corpus operators as queries over the given tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import decontaminate, licences, lines, lm, merkle, mix, pieces, quality, shards, simhash, spelling, toxicity, warc
from barwright.llm.common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: SimHash of 3-word shingles, linked at 2 or fewer differing bits."""
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, read back, and assembled into captures."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.resolve(warc.captures(warc.read(spark, path, payload=False)))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents dropped from all documents."""
    docs = _table(spark, sf_dir, "documents")
    kept = lines.apply_maps(docs, lines.keep_maps(docs))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a bigram model with deleted interpolation."""
    scores, _ = lm.score(_table(spark, sf_dir, "documents"))
    return scores.withColumnRenamed("id", "doc_id")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of nearly equal bytes."""
    index = shards.shard_index(_table(spark, sf_dir, "documents"))
    return index.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    return licences.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("spans")


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules on all documents."""
    return quality.measure(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    held = toxicity.fold_of(F.col("doc_id")) == 0
    return toxicity.scored(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text, with each such text and the edits between them."""
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    taken = mix.mix(_table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as SentencePiece ids and back."""
    import public_tokenizers

    coded = pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle manifest of all documents by language, with each one's proof tried after some texts were altered."""
    altered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tried = merkle.audited(_table(spark, sf_dir, "documents"), altered)
    proof = F.sha2(F.concat_ws("", F.transform("proof", lambda s: s["siblings"])), 256)
    return tried.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of them misspelt on purpose, with their spelling variants."""
    return spelling.group(_table(spark, sf_dir, "documents"), noise=spelling.NOISE)


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), k AS (
  SELECT doc_id, place, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN k.line END, chr(10) ORDER BY place), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, 2.0 * source_size AS cap FROM s
), level AS (
  SELECT 0 AS round, CAST(0 AS DOUBLE) AS rate
  UNION ALL
  SELECT round + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(cap) FILTER (level.rate * weight > cap), 0)) / sum(weight) FILTER (NOT level.rate * weight > cap) FROM w)
  FROM level WHERE round < 40
), t AS (
  SELECT w.source, source_size, least(cap, weight * (SELECT rate FROM level WHERE round = 40)) AS target FROM w
), o AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY (upto + copy * source_size) / target, source NULLS LAST, h, copy ROWS UNBOUNDED PRECEDING) AS total
  FROM o, (VALUES (0), (1)) AS r(copy) WHERE size > 0
), n AS (
  SELECT doc_id, count(*) AS copies FROM c WHERE total <= (SELECT round(sum(target) + 1e-6, 3) FROM t) GROUP BY doc_id
)
SELECT o.doc_id, o.size, o.source_size, o.target, coalesce(n.copies, 0) * o.size AS taken, o.source, coalesce(n.copies, 0) AS copies
FROM o LEFT JOIN n ON o.doc_id = n.doc_id
"""


#: CRC-32 by halves of a byte: each entry is what four steps make of its number.
_CRC16 = [n for n in range(16)]
for _ in range(4):
    _CRC16 = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in _CRC16]


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text of characters up to U+00FF, unsigned."""
    table = f"({_CRC16}::BIGINT[])"
    nibble = lambda c, b: f"xor({c} >> 4, {table}[(xor({c}, {b}) & 15) + 1])"
    half = nibble("c", "b")
    step = nibble(f"({half})", "(b >> 4)")
    codes = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)"
    data = f"flatten(list_transform({codes}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {data}), lambda c, b: {step}), 4294967295)"


def op12_sql(levels: int = 8, above: int = 5) -> str:
    """op12 with the levels written out: for up to 8 ** levels documents of a language, and 8 ** above languages."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR) END"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    name = "CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END"
    parts = [
        f"d AS (SELECT doc_id, {name} AS g, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(text)} END AS other FROM documents)",
        "b0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d)",
        "l0 AS (SELECT g, i, n, leaf AS h FROM b0)",
    ]
    for name, count in (("l", levels), ("r", above)):
        for k in range(count):
            parts.append(f"{name}run{k} AS (SELECT g, i // 8 AS i, n, list(h ORDER BY i) AS hs FROM {name}{k} WHERE n > 1 GROUP BY g, i // 8, n)")
            parts.append(f"{name}{k + 1} AS (SELECT g, i, (n + 7) // 8 AS n, sha256(array_to_string(hs, '')) AS h FROM {name}run{k})")
        tops = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(count + 1))
        parts.append(f"{name}top AS ({tops})")
        if name == "l":
            parts.append("r0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS lang FROM ltop)")
    parts.append("p0 AS (SELECT b.*, r.i AS j, r.h AS subroot, '' AS proof, coalesce(other, leaf) AS back FROM b0 b JOIN r0 r ON r.lang = b.g)")
    at = 0
    for name, count, key, place in (("l", levels, "p.g", "i"), ("r", above, "''", "j")):
        for k in range(count):
            digit, hs = f"CAST((p.{place} // {8**k}) % 8 AS INTEGER)", "r.hs"
            left, right = f"array_to_string({hs}[1:{digit}], '')", f"array_to_string({hs}[{digit} + 2:], '')"
            parts.append(
                f"p{at + 1} AS (SELECT p.* REPLACE (CASE WHEN r.hs IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN r.hs IS NULL THEN back ELSE sha256({left} || back || {right}) END AS back) "
                f"FROM p{at} p LEFT JOIN {name}run{k} r ON r.g = {key} AND r.i = p.{place} // {8 ** (k + 1)})"
            )
            at += 1
    root = "(SELECT h FROM rtop)"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, {root} AS root, sha256(proof) AS proof_sha256, back AS folded_root, back = {root} AS verified FROM p{at}"


#: Near words by what is left of both when one character is masked or deleted.
OP13_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), h AS (
  SELECT run, k, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS k FROM r GROUP BY ALL)
), m AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM h
), w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), c AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM w
), p AS (
  SELECT word, n, substr(word, 1, place - 1) || '?' || substr(word, place + 1) AS mask, substr(word, 1, place - 1) || substr(word, place + 1) AS less FROM c
), e AS (
  SELECT a.word, b.word AS near FROM p a JOIN p b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT p.word, w.word FROM p JOIN w ON p.less = w.word UNION SELECT w.word, p.word FROM p JOIN w ON p.less = w.word
), b AS (
  SELECT e.word, count(*) AS n_near, arg_min(e.near, (-w.n, e.near)) AS near, max(w.n) AS near_n FROM e JOIN w ON w.word = e.near GROUP BY e.word
), f AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n FROM w LEFT JOIN b ON b.word = w.word
), g(word, last) AS (
  SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.last WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, g.last AS root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word JOIN f AS l ON l.word = g.last AND l.form IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_warc, op3_lines, op4_lm, op5_shards, op6_licences, op7_repetition, op8_toxicity, op9_decontaminate, op10_mix, op11_pieces, op12_merkle, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    """Where SQL says the same: the others are tested against brute force in tests/llm."""
    return {"op2_warc": OP2_SQL, "op3_lines": OP3_SQL, "op10_mix": OP10_SQL, "op12_merkle": op12_sql(), "op13_spelling": OP13_SQL}
