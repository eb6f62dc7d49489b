import hashlib
import random

from llm.helpers import rows  # noqa: F401

from quarry.llm.suffix_dedup import repeated_substrings


def brute(docs, length=100):
    texts = {}
    for d, t in docs:
        texts.setdefault(d, (t or "").encode())
    first, gone = {}, {}
    for d in sorted(texts, key=lambda d: (d is None, d)):
        t, g = texts[d], bytearray(len(texts[d]))
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            if first.setdefault(s, (d, p)) != (d, p):
                g[p:p + length] = b"\1" * length
        gone[d] = g
    out = []
    for d, _ in docs:
        t, g = texts[d], gone[d]
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((d, len(t), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(t, g) if not x)).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in repeated_substrings(df, **options).select(*cols).collect()), key=str)


def test_matches_brute_force(tiny):
    want = brute([(r.doc_id, r.text) for r in tiny.collect()])
    assert got(tiny) == want
    assert sum(w[2] for w in want) > 1000


def test_planted_passages(spark):
    rng = random.Random(2)
    letters = "abcdefgh é"
    noise = lambda n: "".join(rng.choices(letters, k=n))
    passages = [noise(n) for n in (60, 95, 96, 99, 100, 101, 130, 400)]
    docs = []
    for d in range(120):
        t = "".join(rng.choice([noise(rng.randrange(0, 120)), rng.choice(passages), rng.choice(passages)[rng.randrange(30):]])
                    for _ in range(rng.randrange(0, 7)))
        docs.append((d * 7 % 120, t))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df) == brute(docs)
    assert got(df, length=40, gram=9) == brute(docs, 40)
    assert got(df, hot_runs=3) == brute(docs)  # most buckets are sorted by Spark
    r = {x.doc_id: x for x in repeated_substrings(df).collect()}
    for d, n, gone, _, sha in brute(docs):
        if not gone:
            assert r[d].kept == dict(docs)[d]


def test_edges(spark, empty):
    long = "".join(chr(97 + (i * i // 7 + i) % 23) for i in range(40_000))
    docs = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 5000), (5, "ab" * 900), (6, long), (6, long), (7, long[5000:9000] + "é" * 300),
            (None, long[:700]), (8, "y" * 100), (9, "y" * 100), (10, "y" * 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df) == brute(docs)
    assert repeated_substrings(empty).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    first, second, third, fourth = noise(150), noise(150), noise(130), noise(400)
    docs = [(1, first + "A" + noise(200)), (2, second + noise(300)),
            (None, first + "B" + noise(900)),     # loses its head, which no other text may lose
            (None, noise(1000)), (None, noise(700) + "C" + second), (None, noise(30)),
            (None, third + "D" + noise(40)), (None, third + "E" + noise(50)),  # a repeat at one place of two null ids
            (3, noise(250) + "F" + first), (3, noise(600)), (3, noise(601)),  # one id, three texts
            (4, fourth), (4, fourth), (4, fourth[:250] + "G" + noise(20)),    # equal rows and another version
            ((1 << 63) - 1, noise(20) + "H" + fourth[100:300]), (None, fourth[100:300])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = [(r.doc_id, r.n_bytes, r.n_removed, r.kept) for r in repeated_substrings(df).collect()]
    assert len(out) == len(docs)
    kept = lambda d, t: [k for i, n, _, k in out if i == d and n == len(t)]
    whole = [0, 1, 3, 5, 9, 10]
    for i in whole:
        assert docs[i][1] in kept(*docs[i])
    assert kept(*docs[2]) == [docs[2][1][150:]] and kept(*docs[4]) == [docs[4][1][:701]] and kept(*docs[8]) == [docs[8][1][:251]]
    assert sorted(len(k) for i in (6, 7) for k in kept(*docs[i])) in ([41, 181], [51, 171])
    a, b = kept(*docs[11]), kept(*docs[13])
    assert (a, b) in (([fourth, fourth], [docs[13][1][250:]]), ([fourth[250:]] * 2, [docs[13][1]]))
    assert kept(*docs[14]) == [docs[14][1][:21]] and kept(*docs[15]) == [""]
    assert got(df.coalesce(1)) == got(df) == got(df, hot_runs=1)
