import random

import numpy as np
from llm.helpers import SPACED, lower, rows

from quarry.llm import near_dedup as N
from quarry.llm import words as W
from quarry.llm.components import components


def shingles(t, k):
    w = SPACED.findall(lower(t))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(docs, k, percent=80):
    sets = {}
    for d, t in docs:
        sets.setdefault(d, shingles(t, k))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if d is not None and sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(((d, len(shingles(t, k)), None if d is None else find(d), d is None or find(d) == d) for d, t in docs), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_matches_brute_force(tiny):
    docs = [(r.doc_id, r.text) for r in tiny.collect()]
    want = brute(docs, 2)
    assert got(N.near_duplicates(tiny, shingle=2)) == want
    assert any(not w[-1] for w in want)


def test_near_copies_and_edges(spark, edge, empty):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(12):  # groups whose copies are nearer to the base than to each other
        base = rng.choices(vocab, k=rng.choice([5, 12, 60, 300]))
        for c in range(25):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 1 + len(t) // 25])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            docs.append((1000 + len(docs), " ".join(t)))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k in (2, 5):
        assert got(N.near_duplicates(df, shingle=k)) == brute(docs, k)
    assert got(N.near_duplicates(edge, shingle=2)) == brute([(r.doc_id, r.text) for r in edge.collect()], 2)
    assert N.near_duplicates(empty).count() == 0
    assert sorted(r["doc_id"] for r in rows(N.deduplicated(df, shingle=2))) == [d for d, _, _, k in brute(docs, 2) if k]


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for n in (3, 40, 2000):
        errors = []
        for _ in range(60):
            s = rng.integers(0, 2**63, size=2 * n, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(s[:n + n // 2]), np.sort(s[n // 2:])
            x, y = N.registers(a), N.registers(b)
            both = len(np.intersect1d(a, b))
            p = N.chance_collision(np.array([float(len(a))]), np.array([float(len(b))]))[0]
            errors.append(((x == y).mean() - p) / (1 - p) - both / (len(a) + len(b) - both))
        assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.06


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    c = {r["node"]: r["component"] for r in rows(components(df))}
    assert c == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_single_word_differs_from_pair():
    buf = np.frombuffer(b"ababab c", np.uint8)
    s = N.shingle_sets(buf, np.array([0, 2, 4, 8]), 2)
    assert s[0] == s[1] and s[2] != s[0] and W.SPACED.sum() == 250


def test_one_id_with_several_texts(spark):
    rng = random.Random(3)
    t1, t2 = (" ".join(f"w{rng.randrange(900)}" for _ in range(120)) for _ in range(2))
    docs = [(1, t1), (1, t2), (2, t2 + " more"), (3, t1 + " more"), (5, "other words here"), (5, "a text of its own"), (5, "a text of its own")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows(N.near_duplicates(df, shingle=2))}
    assert out[(2, 120)] == (1, False) and out[(3, 120)] == (1, False) and out[(1, 119)] == (1, True)
    left = sorted(tuple(r) for r in N.deduplicated(df, shingle=2).collect())
    assert left == sorted([docs[0], docs[1], docs[4], docs[5]])
    docs = [(5, t1), (5, t2), (2, t2 + " more"), (7, t1 + " more")]
    left = N.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2)
    assert sorted(tuple(r) for r in left.collect()) == sorted([docs[0], docs[2]])


def test_stars_in_parts_and_blocks_in_parts(spark, monkeypatch):
    """A hub with more members than a part, open members in more than one block: same groups."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocab, k=200)
    docs = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.choice([2, 8, 14])):
            t[rng.randrange(200)] = rng.choice(vocab)
        docs.append((i, " ".join(t)))
    monkeypatch.setattr(N, "STAR", 7)
    monkeypatch.setattr(N, "BLOCK", 9)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(N.near_duplicates(df, shingle=2)) == brute(docs, 2)


def test_columns_of_any_name(spark):
    docs = [(1, "a b c d e f", 1, "r"), (2, "A b c d e f", 2, "s"), (3, "x", 3, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, node int, rep string")
    assert [r["component_id"] for r in N.near_duplicates(df, shingle=2).orderBy("doc_id").collect()] == [1, 1, 3]
    assert sorted(tuple(r) for r in N.deduplicated(df, shingle=2).collect()) == [docs[0], docs[2]]
