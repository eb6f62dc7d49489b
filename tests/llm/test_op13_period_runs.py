import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from llm.helpers import SPACED, by_id, rows

from quarry.llm import period_runs as P
from quarry.llm import words as W


def brute(x):
    """All runs of a list of words, by the definition."""
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(x[t] == x[t + p] for t in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def row_of(doc_id, words):
    found = brute(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_brute_force():
    rng = random.Random(13)
    for _ in range(600):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            x = []
            for _ in range(rng.randrange(0, 6)):
                x += [rng.choice("abcdefgh"[:rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 10))] * rng.randrange(1, 8)
                x = x[:len(x) - rng.randrange(0, 3)]
                x += ["z"] * (rng.random() < 0.3)
            docs.append(x)
        buf, offs = W.raw(pa.array([" ".join(x) for x in docs]))
        w = W.words(buf, offs, W.SPACED)
        want = [(s + int(w.bound[d]), size, q) for d, x in enumerate(docs) for s, size, q in brute(x)]
        assert list(zip(*(a.tolist() for a in P.runs(w.ident, w.bound)))) == want


def test_splitting_keeps_what_runs_need():
    words = "k1 a b a b a b a b k2 c c c k3 c c c".split()
    buf, offs = W.raw(pa.array([" ".join(words)]))
    w = W.words(buf, offs, W.SPACED)
    assert [x.tolist() for x in P.surviving(w.ident, w.bound)] == [[1], [9]]  # the c's are parted, too few in each part


def test_query_on_tables(tiny, spark):
    some = tiny.unionByName(spark.createDataFrame([(i, "la de so " * 3 + "x y " * i, "en", "a", 0) for i in range(9000, 9040)], tiny.schema))
    want = sorted((row_of(r.doc_id, planted(SPACED.findall(r.text or ""), r.doc_id)) for r in some.collect() if len(r.text or "") < 8000), key=str)
    short = some.filter("length(text) < 8000")
    assert sorted((tuple(r) for r in P.run_digests(P.with_loops(short)).collect()), key=str) == want
    assert sum(r[1] for r in want) > 30


def test_edge_rows(edge, empty):
    got = rows(P.run_digests(edge))
    assert len(got) == edge.count()
    nothing = hashlib.sha256(b"").hexdigest()
    one = by_id(P.run_digests(edge))
    assert all(one[i]["n_runs"] == 0 and one[i]["collapsed_sha256"] == nothing and one[i]["start"] is None for i in (1, 2, 3))
    assert (one[8]["start"], one[8]["period"], one[8]["length"]) == (0, 6, 360_000)
    assert one[8]["collapsed_sha256"] == hashlib.sha256(b"lorem ipsum dolor sit amet consectetur").hexdigest()
    assert (one[10]["n_runs"], one[10]["period"], one[10]["exponent_milli"]) == (1, 3, 300_000)
    assert P.run_digests(empty).count() == 0 and P.with_loops(edge).count() == edge.count()
    full = by_id(P.periodic_runs(edge))
    assert full[10]["collapsed"] == "x y z" and full[10]["runs"][0].asDict() == {"start": 0, "length": 900, "period": 3}


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(None, "a a a a a a", 1, "x"), ("k", None, 2, "y")], "id string, text string, runs int, n_words string")
    got = {r["id"]: r["n_runs"] for r in P.run_digests(docs, id_col="id").collect()}
    assert got == {None: 1, "k": 0}


@pytest.mark.parametrize("n", [5, 6, 7])
def test_least_length(spark, n):
    docs = spark.createDataFrame([(1, "a " * n)], "doc_id long, text string")
    assert P.run_digests(docs).first()["n_runs"] == int(n >= 6)
