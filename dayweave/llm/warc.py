"""WARC archives, index first.

Writing gives an index row per record: file, offset, length, URL and digest. Reading starts from the index: the selected records'
ranges are sorted and coalesced by file, and only those bytes are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayweave.llm.common import shared_dir, staged, table

INDEX = "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, file string, offset long, length long"
_INDEX = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in INDEX.split(", "))])
#: Ranges of one file that lie this close are read as one; one read holds at most RUN_BYTES unless a single record is longer.
GAP_BYTES, RUN_BYTES = 64 << 10, 8 << 20
FILE_BYTES = 1 << 30
#: Tasks that runs are dealt to at most; beyond, a task reads several runs, one after another.
MOST_READERS = 20_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str, mode: str):
    from pyarrow import fs

    where, name = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    if mode == "w":
        where.create_dir(name.rpartition("/")[0], recursive=True)
        return where.open_output_stream(name, compression=None)
    return where.open_input_file(name)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI of the file system that Spark takes it to be on, so that tasks, whose own default may differ, find it there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(record_id: str, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None, date: str) -> bytes:
    """One record, compressed on its own. A revisit keeps the HTTP header, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{record_id}>", f"WARC-Date: {date}", *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{payload_digest}", *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>"] if refers_to is not None else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + deflate.flush()


def parsed(member: bytes) -> dict:
    """Headers and payload of one compressed record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    full = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    return {"fields": fields, "payload": payload, "payload_bytes": full}


def write(df: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Writes a record per row under root and returns the index, itself written there as Parquet before this returns.

    Of records with equal payloads of at least least_bytes, the one with the smallest id is a response and the others revisit it; rows
    that tie for the smallest id are all responses. Null html is an empty payload; a null URL writes no target; rows with a null id are
    always responses and are never referred to. Each task attempt writes files of its own, and only those named in the index count, so
    lost executors and repeated attempts do no harm. Other columns are ignored.
    """
    root = qualified(df.sparkSession, root)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    key = F.col(f"`{id_col}`")
    rows = df.select(key.alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.sha1("payload"))
    # A written table here leaves Spark free to split the rows of a frequent payload, which an aggregation would keep together.
    first = rows.filter((F.octet_length("payload") >= least_bytes) & F.col("id").isNotNull()).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    first = staged(first, "warc-first")
    joined = rows.join(first.hint("merge"), "sha", "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(F.col("id") > F.col("first"), F.col("first")).cast("string").alias("refers_to"))

    def put(batches):
        out, at, name = None, 0, ""
        for rb in batches:
            found = {n: [] for n in _INDEX.names}
            for rid, url, payload, refers in zip(*(rb.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, at = _open(name, "w"), 0
                sha = digest(payload)
                member = record(rid if rid is not None else f"none-{uuid.uuid4().hex}", url, payload, sha, refers, date)
                out.write(member)
                for n, v in zip(_INDEX.names, (rid, url, "response" if refers is None else "revisit", refers, len(payload), sha, name, at, len(member)), strict=True):
                    found[n].append(v)
                at += len(member)
            yield pa.RecordBatch.from_pydict(found, schema=_INDEX)
        if out is not None:
            out.close()

    index = joined.mapInArrow(put, INDEX)
    index.write.parquet(f"{root}/index")
    return df.sparkSession.read.schema(index.schema).parquet(f"{root}/index")


def read(index: DataFrame, with_payload: bool = True, verify: bool = True) -> DataFrame:
    """The records that index (or a selection of it) names: record_id, url, record_type, refers_to, payload_bytes, payload_digest and,
    unless declined, payload (null for revisits).

    Ranges are dealt by file and megabyte run, sorted by offset, and neighbours closer than GAP_BYTES become one read. With verify, a
    payload whose digest or length differs from its headers fails the job. A selection may repeat rows; the record is then returned as often.
    """
    runs = index.select("file", "offset", "length").filter("file is not null").withColumn("run", F.floor(F.col("offset") / RUN_BYTES))

    def get(batches):
        kept: list[tuple[str, int, int]] = []

        def flush():
            name, first = kept[0][0], kept[0][1]
            end = max(o + n for _, o, n in kept)
            with _open(name, "r") as f:
                f.seek(first)
                data = f.read(end - first)
            found = {n: [] for n in ("record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")}
            for _, o, n in kept:
                r = parsed(data[o - first : o - first + n])
                fields, revisit = r["fields"], r["fields"]["WARC-Type"] == "revisit"
                sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if verify and not revisit and (digest(r["payload"]) != sha or len(r["payload"]) != r["payload_bytes"]):
                    raise ValueError(f"digest or length mismatch in {name} at {o}")
                rid = re.fullmatch("<urn:record:(.*)>", fields["WARC-Record-ID"], re.S)[1]
                refers = re.fullmatch("<urn:record:(.*)>", fields["WARC-Refers-To"], re.S)[1] if revisit else None
                for k, v in zip(found, (None if rid.startswith("none-") else rid, fields.get("WARC-Target-URI"), fields["WARC-Type"], refers, r["payload_bytes"], sha, None if revisit or not with_payload else r["payload"]), strict=True):
                    found[k].append(v)
            kept.clear()
            return pa.RecordBatch.from_pydict(found, schema=pa.schema([(k, pa.int64() if k == "payload_bytes" else pa.binary() if k == "payload" else pa.string()) for k in found]))

        for rb in batches:
            for name, o, n in zip(*(rb.column(i).to_pylist() for i in range(3)), strict=True):
                if kept and (name != kept[0][0] or o - (kept[-1][1] + kept[-1][2]) > GAP_BYTES or o + n - kept[0][1] > RUN_BYTES):
                    yield flush()
                kept.append((name, o, n))
        if kept:
            yield flush()

    held = runs.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]  # the index is small but its reads aren't: a fixed count keeps them apart
    dealt = runs.repartition(min(MOST_READERS, max(1, -(-held // RUN_BYTES))), "file", "run").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    out = dealt.mapInArrow(get, "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out if with_payload else out.drop("payload")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: archives every page, then reads all records back."""
    index = write(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    back = read(index, with_payload=False)
    return back.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     f AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, upper(sha1(html)) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda b: ((instr('0123456789ABCDEF', substr(hex, 1 + (5 * k + b)::INT // 4, 1)) - 1) >> (3 - (5 * k + b)::INT % 4) & 1) << (4 - b)::INT))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
