import zlib

import numpy as np
import pytest
from llm.helpers import EDGE

from quarry.llm import token_output as O
from quarry.llm import units as U
from quarry.llm.shards import range_bounds

PATH = U.tokenizer_path(U.DEFAULT_TOKENIZER)


def expected(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, -1 if d[1] is None else len(d[1].encode()), (d[1] or "").encode()))
    codes = U.load_tokenizer(PATH).encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    out, start = [], 0
    for (d, _), e in zip(docs, codes):
        ids = np.array(e.ids + [2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"file_ids": 700, "shard_bytes": 40_000}])
def test_files_hold_all_ids(tiny, options):
    want = expected([(r.doc_id, r.text) for r in tiny.collect()])
    assert got(O.token_files(tiny, **options)) == want


def test_edges(edge, empty):
    assert got(O.token_files(edge, file_ids=50)) == expected([(r[0], r[1]) for r in EDGE])
    assert O.token_files(empty).count() == 0


@pytest.mark.parametrize("vocabulary", [2, 3, 256, 257, 49_408, 65_537, 200_000])
def test_round_trip_and_random_access(vocabulary):
    rng = np.random.default_rng(vocabulary)
    bits = O.bits_for(vocabulary)
    assert 2 ** bits >= vocabulary > 2 ** (bits - 1) or vocabulary == 2
    ids = rng.integers(0, vocabulary, 10_001).astype(np.uint32)
    ends = np.sort(rng.integers(0, 10_002, 40))
    ends[-1] = len(ids)
    data = b"".join(O.file_chunks(ids, ends, np.arange(40), np.zeros(40, bool), bits, block_ids=333))
    f = O.TokenFile(data)
    assert f.bits == bits and len(data) < 10_001 * bits / 8 + 1500
    for lo, hi in [(0, 10_001), (5, 6), (330, 340), (9_990, 10_001), (7, 7)]:
        assert (f.ids(lo, hi) == ids[lo:hi]).all()
    assert (f.document(3) == ids[ends[2]:ends[3]]).all()


def test_bounds_follow_clustered_keys(spark):
    from pyspark.sql import functions as F
    df = spark.range(10_000).select(F.when(F.col("id") < 9_000, F.col("id")).otherwise(F.col("id") * 10**12).alias("k"))
    b = range_bounds(df, "k", F.lit(1), 1000)
    keys = np.array([r.k for r in df.collect()])
    n = np.bincount(np.searchsorted(b, keys, side="right"))
    assert b == sorted(b) and n.max() <= 1100 and len(n) <= 14
