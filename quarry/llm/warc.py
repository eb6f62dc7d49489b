"""Deterministic sharded WARC writer and its reader.

Pages are range-sorted by id into shards of about equal bytes. A task writes its shard as gzip members,
one per record, and starts a new file when the compressed size reaches ``file_bytes``. Headers (WARC and
HTTP) and digests are made anew from the payload, dates and record ids from parameters and content, so
a run on the same pages gives the same bytes. A file is written under a temporary name and renamed. The
manifest is a table in the archives' folder that names every file with its records, bytes and digest;
MANIFEST.json, with the totals, is committed last and makes the run a finished one. The reader goes by them:
it refuses a folder without MANIFEST.json, reads the named files and no others (left behind by an attempt that
was lost, or put there by someone else), and fails on a file whose bytes are not those of the manifest.

Payloads of at least ``least`` bytes that equal an earlier one (smaller page_id) become revisit records
without payload. Digests are grouped with map-side aggregation; only pages whose digest passes a sieve of
the repeated digests are joined with them, and a very common payload is split by Spark's skew join.

Defined cases: a null html is an empty payload; a null url becomes urn:page:<id>; a null page_id comes
last, and counts as larger than all others; of rows that repeat page_id and payload the first is the
response and the others revisit it; an empty table writes no archive; extra columns are ignored."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bitmap import sieve, sieved
from quarry.llm.shards import commit_file, filesystem, range_bounds, shard_of
from quarry.llm.store import bounded_batches, materialize, scratch

LEAST_REVISIT = 100
FILE_BYTES = 16 << 20
SHARD_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_LAST = (1 << 63) - 1
MANIFEST = "file string, records long, bytes long, sha256 string"
_TABLE = "manifest"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{digest}'.encode()).digest()[:16], version=5)}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def info_record(name: str, date: str) -> bytes:
    block = b"software: quarry\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name, "")), ("WARC-Date", date), ("WARC-Filename", name),
                    ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))], block)


def page_record(page_id, url, payload: bytes | None, size: int, digest: str, first, date: str) -> bytes:
    """A response, or with ``payload`` None a revisit of page ``first``. Null ids are written as empty."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    text = lambda x: "" if x is None else str(x)
    target = f"urn:page:{text(page_id)}" if url is None else quote(url, safe="".join(map(chr, range(33, 127))))
    headers = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)),
               ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("WARC-Page-Id", text(page_id)),
               ("WARC-Payload-Length", str(size))]
    if payload is None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(first, digest)), ("WARC-Refers-To-Page-Id", text(first))]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _member(headers, block)


def read_records(data):
    """(headers, block) of every record of an archive's bytes."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))
    while f.peek(1):
        version = f.readline()
        if version.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {}
        while (line := f.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(":")
            headers[k] = v.strip()
        n = int(headers["Content-Length"])
        block = f.read(n)
        if len(block) != n or f.read(4) != b"\r\n\r\n":
            raise ValueError("cut record")
        yield headers, block


def _writer(folder: str, date: str, file_bytes: int, least: int):
    def run(batches):
        shard, seq, held, size, n, last = None, 0, [], 0, 0, None

        def flush():
            nonlocal seq, held, size, n
            name = f"pages-{shard:05d}-{seq:05d}.warc.gz"
            data = [info_record(name, date), *held]
            sha = hashlib.sha256()
            for d in data:
                sha.update(d)
            written = commit_file(folder, name, data)
            row = {"file": [name], "records": [n], "bytes": [written], "sha256": [sha.hexdigest()]}
            seq, held, size, n = seq + 1, [], 0, 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            names = ("shard", "page_id", "url", "html", "bytes", "digest", "first")
            for own, page, url, html, many, digest, first in zip(*(batch.column(c) for c in names)):
                own, page, many, digest, first = (x.as_py() for x in (own, page, many, digest, first))
                if own != shard:
                    if n:
                        yield flush()
                    shard, seq, last = own, 0, None
                copy = many >= least and first is not None and first != (_LAST if page is None else page)
                again = many >= least and (page, digest) == last  # the row before was this page with this payload
                last = (page, digest)
                payload = None if copy or again else (html.as_py() or "").encode()
                if not copy:
                    first = _LAST if page is None else page
                held.append(page_record(page, url.as_py(), payload, many, digest, None if first == _LAST else first, date))
                size, n = size + len(held[-1]), n + 1
                if size >= file_bytes:
                    yield flush()
        if n:
            yield flush()
    return run


_ROWS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
         "refers_to": pa.int64()}


def _reader(folder: str):
    """Rows of the records of the named files, one file in memory at a time."""
    number = lambda x: int(x) if x else None

    def held(name: str, records: int, size: int, sha256: str):
        fs, base = filesystem(folder)
        with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
            data = f.read()
        if len(data) != size or hashlib.sha256(data).hexdigest() != sha256:
            raise ValueError(f"{name} is not the file of the manifest")
        out = {k: [] for k in _ROWS}
        for h, block in read_records(data):
            if h["WARC-Type"] == "warcinfo":
                continue
            digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
            size = int(h["WARC-Payload-Length"])
            if h["WARC-Type"] == "response":
                payload = block[block.index(b"\r\n\r\n") + 4:]
                size = len(payload)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its digest")
            for k, v in zip(out, (number(h["WARC-Page-Id"]), size, digest, h["WARC-Type"], number(h.get("WARC-Refers-To-Page-Id")))):
                out[k].append(v)
        if len(out["page_id"]) != records:
            raise ValueError(f"{name} holds {len(out['page_id'])} records, the manifest says {records}")
        return pa.RecordBatch.from_pydict({k: pa.array(v, _ROWS[k]) for k, v in out.items()})

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield held(row["file"], row["records"], row["bytes"], row["sha256"])
    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> DataFrame:
    """Write the pages into ``folder``; returns the manifest (file, records, bytes, sha256)."""
    bounded_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
            .withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)))
    slim = materialize(rows.select("page_id", "bytes", "digest"), "payloads")
    firsts = materialize(slim.filter(F.col("bytes") >= least).groupBy("digest")
                         .agg(F.min(F.coalesce("page_id", F.lit(_LAST))).alias("first"), F.count("*").alias("n"))
                         .filter("n > 1").select("digest", "first"), "firsts")
    seen = sieved(rows, "digest", sieve(firsts, "digest"))
    columns = ["page_id", "url", "html", "bytes", "digest"]
    single = seen.filter("not may_have").select(*columns, F.lit(None).cast("long").alias("first"))
    copied = seen.filter("may_have").select(*columns).join(firsts, "digest", "left")
    is_copy = F.col("first").isNotNull() & (F.col("first") != F.coalesce("page_id", F.lit(_LAST)))
    copied = copied.withColumn("html", F.when(~is_copy, F.col("html"))).select(*columns, "first")
    bounds = range_bounds(slim, "page_id", F.col("bytes") + 512, shard_bytes)
    dealt = (single.union(copied).withColumn("shard", shard_of("page_id", bounds, nulls_last=True))
             .repartitionById(len(bounds) + 1, F.col("shard"))
             .sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "url")
             .select("shard", "page_id", "url", "html", "bytes", "digest", "first"))
    dealt.mapInArrow(_writer(folder, date, file_bytes, least), MANIFEST).write.parquet(f"{folder}/{_TABLE}")
    manifest = pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/{_TABLE}")
    total = manifest.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    commit_file(folder, "MANIFEST.json", [json.dumps({"table": _TABLE, **dict(zip(("files", "records", "bytes"), total))}).encode()])
    return manifest


def read_archives(spark, folder: str, read_bytes: int = 2 * FILE_BYTES) -> DataFrame:
    """Per record of a finished run's archives: page_id, payload_bytes, payload_digest, record_type, refers_to.
    A task reads files of about ``read_bytes`` together. FileNotFoundError where there is no MANIFEST.json."""
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/MANIFEST.json") as f:
        total = json.loads(f.read())
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/{total['table']}")
    found = manifest.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if tuple(found) != (total["files"], total["records"], total["bytes"]):
        raise ValueError(f"the manifest of {folder} is not the one that was committed")
    tasks = max(1, min(total["files"], -(-total["bytes"] // read_bytes)))
    return manifest.repartition(tasks, "file").mapInArrow(_reader(folder), ", ".join(
        f"{k} {'string' if t == pa.string() else 'long'}" for k, t in _ROWS.items()))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and return what they hold."""
    folder = scratch(pages.sparkSession, "warc")
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder)


ORACLE = f"""
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM payloads GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN p.n >= {LEAST_REVISIT} AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= {LEAST_REVISIT} AND f.first <> p.page_id THEN f.first END AS refers_to
FROM payloads p JOIN firsts f USING (digest)"""
