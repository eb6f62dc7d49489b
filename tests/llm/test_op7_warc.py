import hashlib

import pytest

from llm.helpers import TINY, rows
from oracle_harness import canon, duck

from quarry.llm import warc as A
from quarry.llm.shards import filesystem
from quarry.llm.store import scratch

PAGES = [(5, "http://a/ ü\r\nX: y", "x" * 100), (3, None, "x" * 100), (9, "u", "x" * 99), (10, "u", "x" * 99), (None, "n", "y" * 300),
         (None, "n", "y" * 300), (7, "u", None), (8, "u", ""), (11, "u", "é" * 60), (12, "v", "é" * 60), (12, "v", "é" * 60),
         (13, "w", "WARC/1.1\r\n\r\n" * 40), (14, "w", "z" * 200_000), (2, "w", "z" * 200_000), (15, "q", "y" * 300)]
SCHEMA = "page_id long, url string, html string"


def brute(pages):
    last = 1 << 63
    order = sorted(range(len(pages)), key=lambda i: last if pages[i][0] is None else pages[i][0])
    first, out = {}, []
    for i in order:
        p, _, h = pages[i]
        b = (h or "").encode()
        again = len(b) >= 100 and b in first
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
        first.setdefault(b, p)
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edges(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    assert got(A.archived(df)) == brute(PAGES)
    assert got(A.archived(df, file_bytes=500, shard_bytes=2000)) == brute(PAGES)
    assert A.archived(df.limit(0)).count() == 0


def test_query_equals_oracle(spark):
    from quarry.llm.queries import ORACLE, QUERIES
    a = QUERIES["op7_warc"](spark, TINY).toPandas()
    assert canon(a) == canon(duck(TINY).sql(ORACLE["op7_warc"]).df())


def test_same_bytes_on_every_run(spark):
    pages = spark.read.parquet(f"{TINY}/pages.parquet")
    one, two = (scratch(spark, "warc") for _ in range(2))
    a = got(A.write_archives(pages, one, file_bytes=20_000, shard_bytes=60_000))
    b = got(A.write_archives(pages.repartition(5), two, file_bytes=20_000, shard_bytes=60_000))
    assert a == b and len(a) > 3
    fs, base = filesystem(one)
    for name, records, size, sha in a:
        data = fs.open_input_stream(f"{base}/{name}", compression=None).read()
        assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
        held = list(A.read_records(data))
        assert held[0][0]["WARC-Type"] == "warcinfo" and len(held) == records + 1
        for h, block in held[1:]:
            assert h["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    assert rows(pages.limit(1))


def test_reader_goes_by_the_manifest(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    folder = scratch(spark, "warc")
    files = [r["file"] for r in A.write_archives(df, folder, file_bytes=500, shard_bytes=2000).collect()]
    fs, base = filesystem(folder)
    read = lambda name: fs.open_input_stream(f"{base}/{name}", compression=None).read()
    with fs.open_output_stream(f"{base}/pages-09999-00000.warc.gz", compression=None) as f:  # no file of the run
        f.write(read(files[0]))
    assert got(A.read_archives(spark, folder)) == brute(PAGES)
    whole = read(files[0])
    with fs.open_output_stream(f"{base}/{files[0]}", compression=None) as f:
        f.write(whole[:-1] + bytes([whole[-1] ^ 1]))
    with pytest.raises(Exception, match="not the file of the manifest"):
        A.read_archives(spark, folder).collect()
    fs.delete_file(f"{base}/MANIFEST.json")
    with pytest.raises(FileNotFoundError):
        A.read_archives(spark, folder)


def test_clashing_columns_and_many_pages_without_id(spark):
    pages = [(None, "u", f"{'q' * 120}{i % 40}") for i in range(120)] + [(i, "u", "r" * 150) for i in range(40)]
    df = spark.createDataFrame(pages, SCHEMA).selectExpr("*", "1 AS shard", "'x' AS digest", "2 AS first", "3 AS bytes", "true AS may_have")
    assert got(A.archived(df, file_bytes=3000, shard_bytes=4000)) == brute(pages)
