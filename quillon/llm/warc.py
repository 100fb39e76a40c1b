"""WARC archives: write pages as segmented records, reassemble them on reading.

Writer: one ``response`` or ``revisit`` record per page. The HTTP body is framed
as chunked transfer coding; a block longer than ``segment_bytes`` goes into a
first record and ``continuation`` records that name its identifier. Archives are
gzipped by Spark's own text sink, so they reach any store that Spark reaches.

Reader: archives are parsed by Content-Length, the segments of a record are
grouped by origin identifier, ordered by segment number, checked against the
total length, and the chunked framing is decoded.

Defined results: null html is an empty payload; a null page_id stays null and
never wins over one that is not; repeated rows give a record each, and all rows
that share the largest page_id of a payload are responses; a very long payload is
as many segments as it fills, joined whole on reading; an empty table gives
no records; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import hot_keys, materialize, new_path, pick, spread_join, table

#: Payloads below this length are never deduplicated.
MIN_DEDUP_BYTES = 1000
SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
#: A record is at most a segment and its header, so this bounds an archive's size (about 9 MB).
RECORDS_PER_ARCHIVE = 1024

_END = b"\r\n\r\n"
_RECORD_SCHEMA = "record_id string, page_id string, url string, kind string, digest string, refers_to string, segment int, origin string, total long, block binary"


def frame_chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(body), size) if (p := body[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def decode_chunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        eol = data.index(b"\r\n", at)
        n = int(data[at:eol].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(data[eol + 2 : eol + 2 + n])
        if len(out[-1]) != n:
            raise ValueError("a chunk ends early")
        at = eol + 2 + n + 2


def http_block(body: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame_chunked(body)


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(_END)
    if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")):
        return decode_chunked(body)
    return body


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def records_of(page_id: int | None, url: str | None, body: bytes, kind: str, digest: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end each."""
    rid = f"<urn:uuid:{uuid.uuid4()}>"
    clean = None if url is None else re.sub(r"[\r\n]+", " ", url)
    common = [("WARC-Record-ID", rid), ("WARC-Target-URI", clean), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", None if page_id is None else str(page_id))]
    if kind == "revisit":
        head = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
        yield _record([("WARC-Type", kind), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to)), ("Content-Type", "application/http; msgtype=response")], head)
        return
    block = http_block(body)
    first, rest = block[:segment_bytes], block[segment_bytes:]
    yield _record([("WARC-Type", kind), *common, ("WARC-Segment-Number", "1" if rest else None), ("Content-Type", "application/http; msgtype=response")], first)
    for n, i in enumerate(range(0, len(rest), segment_bytes), 2):
        last = i + segment_bytes >= len(rest)
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", str(n)), ("WARC-Segment-Total-Length", str(len(block)) if last else None)], rest[i : i + segment_bytes])


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive, read by Content-Length."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(_END, at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != _END:
            raise ValueError(f"the record at byte {at} ends early")
        yield head | {"block": block}
        at = end + 8 + n


def _write_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = zip(b.page_id, b.url, b.payload, b.record_type, b.payload_digest, b.refers_to, strict=True)
        none = lambda x: None if pd.isna(x) else x
        yield pd.DataFrame({"value": [r for p, u, body, k, d, t in rows for r in records_of(none(p), none(u), bytes(body), k, d, none(t))]})


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _RECORD_SCHEMA.split(", ")]
    for b in batches:
        for content in b.content:
            rows = []
            for h in parse(gzip.decompress(content)):
                digest = h.get("WARC-Payload-Digest")
                rows.append((h["WARC-Record-ID"], h.get("X-Page-ID"), h.get("WARC-Target-URI"), h["WARC-Type"], digest and digest.partition(":")[2], h.get("X-Refers-To-Page"), int(h.get("WARC-Segment-Number", 0)), h.get("WARC-Segment-Origin-ID"), int(h.get("WARC-Segment-Total-Length", -1)), h["block"]))
            yield pd.DataFrame(rows, columns=names)


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to."""
    d = pick(pages, page_id="long", url="string", html="string").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    # only payloads that occur again; counts combine before the shuffle, so a hot payload is a few rows
    again = materialize(d.filter(F.col("payload_bytes") >= MIN_DEDUP_BYTES).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "payloads")
    keys = ["payload_digest", "payload_bytes"]
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    joined = spread_join(d, again.drop("n"), keys, hot_keys(again, keys, "n"), ["page_id", "url"])
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first_id"))}).drop("first_id")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` as gzipped archives under ``path``."""
    rows = classify(pages).select("page_id", "url", "payload", "record_type", "payload_digest", "refers_to")
    out = rows.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")}).mapInPandas(_write_batches, "value binary")
    # bytes cast to string stay as they are, and the sink writes them as they are
    out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_read_batches, _RECORD_SCHEMA)


def _payloads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        bodies = []
        for segments, kind in zip(b.segments, b.kind, strict=True):
            got = sorted((s["segment"], s["total"], s["block"]) for s in segments)
            block = b"".join(x[2] for x in got)
            total = got[-1][1]
            numbers = [x[0] for x in got]
            if len(got) > 1 and (numbers != list(range(1, len(got) + 1)) or total != len(block)):
                raise ValueError(f"segments {numbers} have {len(block)} bytes of {total}")
            if len(got) == 1 and numbers[0] != 0:
                raise ValueError("a segmented record lacks its continuations")
            bodies.append(block if kind == "revisit" else http_payload(block))
        out = b[["page_id", "url", "kind", "digest", "refers_to"]].copy()
        out["payload"] = [None if k == "revisit" else x for k, x in zip(b.kind, bodies, strict=True)]
        out["payload_bytes"] = [int(re.search(rb"Content-Length: (\d+)", x)[1]) if k == "revisit" else len(x) for k, x in zip(b.kind, bodies, strict=True)]
        bad = [d for k, d, x in zip(b.kind, b.digest, bodies, strict=True) if k == "response" and hashlib.sha1(x).hexdigest() != d]
        if bad:
            raise ValueError(f"payload digest differs: {bad[0]}")
        yield out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, kind, digest, refers_to, payload (null for revisits), payload_bytes.

    Whole records pass through; only segmented ones are shuffled, by origin, so
    a group is the segments of one record.
    """
    r = read_records(spark, path).withColumn("segmented", (F.col("segment") > 0))
    part = F.struct("segment", "total", "block")
    whole = r.filter("not segmented").withColumn("segments", F.array(part))
    keyed = r.filter("segmented").withColumn("origin", F.coalesce("origin", "record_id"))
    joined = keyed.groupBy("origin").agg(*[F.max(c).alias(c) for c in ("page_id", "url", "digest", "refers_to")], F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"), F.collect_list(part).alias("segments"))
    cols = ["page_id", "url", "kind", "digest", "refers_to", "segments"]
    return whole.select(cols).unionByName(joined.select(cols)).mapInPandas(_payloads, "page_id string, url string, kind string, digest string, refers_to string, payload binary, payload_bytes long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


OP8_SQL = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, h, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
