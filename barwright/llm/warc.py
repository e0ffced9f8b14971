"""WARC archives: a distributed writer and reader, and the assembly of records into captures."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import join_by_key, keep

END = "\r\n\r\n"
LEAST_PAYLOAD = 100
#: Captures in a file, by the bytes of their payloads: up to FILE_TIER bytes, and for each factor of TIER_STEP more that
#: part of it. So a file holds a few hundred MB at most, or one capture.
CAPTURES_PER_FILE = 2000
FILE_TIER, TIER_STEP, TIERS = 32 << 10, 8, 6
#: Copies of payloads are looked up by broadcast up to this many distinct payloads (under 200 bytes each), else by a join.
BROADCAST_ROWS = 20_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "rtype string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string, header_digest string, payload binary"


def _uuid(*parts) -> F.Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind, record_id, uri, date, block, *headers) -> F.Column:
    """One record without the line breaks that end it; a header whose value is null is left out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    own = [line("WARC-Type", kind), line("WARC-Record-ID", record_id), line("WARC-Date", date), line("WARC-Target-URI", uri), *(line(*h) for h in headers), line("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *own), F.lit(END), block)


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_PAYLOAD, codec: str = "gzip", broadcast_rows: int = BROADCAST_ROWS) -> None:
    """Write request, response or revisit, and metadata records for each row of pages(page_id, url, html).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of at least `least` bytes, the one with
    the smallest page_id (nulls last, then the smallest url) is the response and the others revisit it; smaller payloads
    are all responses. Long payloads go to files of their own with fewer captures. Records of a row refer to each other by WARC-Concurrent-To, and a revisit to its response by
    target URI, date and payload digest. A null url has no WARC-Target-URI; line breaks in a url are percent-encoded.
    Repeated rows are captures of their own, and all responses if one is. Spark's text writer commits the files, with
    the record end as line separator, so a lost executor leaves no half archive.
    """
    crlf = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", crlf.alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"), _uuid(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha2(html, 256), F.monotonically_increasing_id()).alias("rid"))
    order = F.struct(F.isnull("page_id").alias("none"), "page_id", F.isnull("url").alias("no_url"), "url")
    firsts = base.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = keep(firsts)
    if firsts.count() <= broadcast_rows:
        rows = base.join(F.broadcast(firsts.drop("n")), "digest", "left")
    else:  # frequent payloads by broadcast; the rows of those keep their place in the join of the others
        heavy = firsts.orderBy(F.desc("n"), "digest").limit(max(broadcast_rows, 0))
        rare = firsts.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(F.col("digest").alias("_key"), F.col("first").alias("_first"))
        rows = base.join(F.broadcast(heavy.drop("n")), "digest", "left").withColumn("_key", F.when(F.col("first").isNull(), F.col("digest")).otherwise(F.col("rid")))
        rows = rows.join(rare, "_key", "left").withColumn("first", F.coalesce("first", "_first"))
    again = F.col("first").isNotNull() & ~(F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url")))
    sha = F.concat(F.lit("sha256:"), F.col("digest"))
    at = F.lit(date)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    answer = F.when(
        again,
        _record(F.lit("revisit"), F.col("rid"), F.col("url"), at, http, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To-Target-URI", F.col("first.url")), ("WARC-Refers-To-Date", at), ("WARC-Payload-Digest", sha), ("Content-Type", F.lit("application/http; msgtype=response"))),
    ).otherwise(_record(F.lit("response"), F.col("rid"), F.col("url"), at, F.concat(http, "html"), ("WARC-Payload-Digest", sha), ("Content-Type", F.lit("application/http; msgtype=response"))))
    ask = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + END))
    request = _record(F.lit("request"), _uuid("rid", F.lit("request")), F.col("url"), at, ask, ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/http; msgtype=request")))
    fields = F.concat_ws("\r\n", F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("payloadBytes: "), F.col("bytes").cast("string")), F.lit(""))
    metadata = _record(F.lit("metadata"), _uuid("rid", F.lit("metadata")), F.col("url"), at, fields, ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/warc-fields")))
    tier = sum(((F.col("bytes") > FILE_TIER * TIER_STEP**k).cast("int") for k in range(TIERS - 1)), F.lit(0))
    out = rows.select(F.concat_ws(END, request, answer, metadata).alias("value"), tier.alias("tier"))
    tiers = sorted(r[0] for r in base.select(tier.alias("tier")).distinct().collect()) or [0]  # at most TIERS
    for k in tiers:
        writer = out.where(F.col("tier") == k).select("value").write.mode("errorifexists" if k == tiers[0] else "append")
        writer.option("lineSep", END).option("compression", codec).option("maxRecordsPerFile", max(1, CAPTURES_PER_FILE // TIER_STEP**k)).text(path)


def _pieces(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The archive's bytes; gzip members one after another are expanded piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = content
    while rest:
        member, at = zlib.decompressobj(wbits=31), 0
        while not member.eof and at < len(rest):
            piece = member.decompress(rest[at : at + step])
            at += step
            if piece:
                yield piece
        rest = member.unused_data + rest[at:] if member.eof else b""


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, framed by Content-Length."""
    held, pieces, ended = bytearray(), _pieces(content), False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends within a record header")
                return
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        while len(held) < end + 8 + size:
            if not more():
                break
        if len(held) < end + 4 + size:
            raise ValueError("an archive ends within a record block")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def _rows(contents: Iterable[bytes], keep_payload: bool) -> Iterator[tuple]:
    for content in contents:
        for fields, block in parse(content):
            kind, page, payload, size = fields["warc-type"], None, None, None
            if kind in ("response", "revisit"):
                payload = block.partition(b"\r\n\r\n")[2]
            if kind == "metadata":
                found = re.search(rb"^pageId: (-?\d+)\r?$", block, re.M)
                page = int(found[1]) if found else None
            digest = hashlib.sha256(payload).hexdigest() if kind == "response" else None
            size = len(payload) if kind == "response" else None
            yield (kind, fields["warc-record-id"], fields.get("warc-concurrent-to"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), page, size, digest, fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, payload if keep_payload else None)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives below `path`, plain or gzip (whole files or a member per record): see RECORDS.

    Archives without records give no rows. A file is read as one row, so it must be below 2 GB.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        held, size = [], 0
        for b in batches:
            for row in _rows((c.as_py() for c in b.column(0)), payload):
                held.append(row)
                size += 400 + len(row[-1] or b"")
                if size > 4 << 20:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata.

    Request and metadata records meet their response or revisit under the identifier they are concurrent to. `response`
    is null where an archive holds no such record; several records of one kind stay side by side in the arrays; no records
    give no rows.
    """
    one = F.struct("rtype", "record_id", "refers_to", "target_uri", "date", "payload_bytes", "payload_digest", "header_digest", "payload")
    side = F.struct("record_id", "target_uri", "date", "page_id")
    answered = F.col("rtype").isin("response", "revisit")
    keyed = records.withColumn("capture_id", F.when(answered, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    return keyed.groupBy("capture_id").agg(
        F.first(F.when(answered, one), ignorenulls=True).alias("response"),
        F.collect_list(F.when(F.col("rtype") == "request", side)).alias("requests"),
        F.collect_list(F.when(F.col("rtype") == "metadata", side)).alias("metadata"),
    )


def resolve(assembled: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits get the payload that their digest names.

    refers_to is the smallest page_id among the responses with that payload. A revisit without its response in the
    archives keeps its digest, with no bytes.
    """
    flat = keep(assembled.where("response is not null").select(F.col("metadata")[0]["page_id"].alias("page_id"), F.col("response.rtype").alias("record_type"), F.col("response.header_digest").alias("named"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")))
    first = flat.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    owner = F.min(F.struct(F.isnull("page_id").alias("none"), "page_id"))
    seen = first.groupBy("payload_digest").agg(owner.alias("owner"), F.first("payload_bytes").alias("of_bytes")).withColumnRenamed("payload_digest", "named")
    revisits = flat.where("record_type = 'revisit'").withColumn("named", F.coalesce("named", F.lit("")))
    named = keep(revisits.groupBy("named").agg(F.count("*").alias("n")).join(seen, "named", "left"))
    again = join_by_key(revisits, named, "named", "n").withColumn("named", F.nullif("named", F.lit("")))
    return first.unionByName(again.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.col("named").alias("payload_digest"), "record_type", F.col("owner.page_id").alias("refers_to")))
