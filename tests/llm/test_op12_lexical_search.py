import math
import random
import re
from collections import Counter

from llm.helpers import lower

from quarry.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    words = {}
    for i, t in items:
        if t is not None:
            words.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for i, terms in words.items():
        scored = []
        for d, b in bags:
            if b:
                m = 100 - 90 + (90 * sum(b.values()) * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if t in b)
                if s > 0:
                    scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def check(docs, items, **more):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], more.get("k", 10))
    got = sorted((tuple(r) for r in L.ranked_documents(docs, items, **more).collect()), key=str)
    assert got == want
    return got


def test_ranks_equal_brute_force(tiny, spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert len(check(tiny, items)) > 100


def test_ties_copies_and_blocks(spark):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(40)]
    docs = [(rng.randrange(500), " ".join(rng.choices(vocab, k=rng.randrange(0, 9)))) for _ in range(400)]
    docs += [(i, "w1 W2 w3 other") for i in range(900, 600, -1)] + [(None, "w1 w2 w3 other")] * 3 + [(7, None), (8, ""), (9, "--")]
    items = [(i, " ".join(rng.choices(vocab, k=6))) for i in range(30)] + [(3, "w1 extra"), (40, "w1 w2 w3"), (41, ""), (42, None), (43, "nowhere"), (None, "w5")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame(items, "item_id long, text string")
    got = check(docs, items)
    assert check(docs, items, item_bytes=100) == got  # many blocks of items
    check(docs, items, k=3)
    check(docs, items, k=700)


def test_one_class_holds_a_third(spark, monkeypatch):
    docs = [(i, "a b") for i in range(1000)] + [(i, f"a c{i % 90} " * (i % 7)) for i in range(1000, 3000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "c5 c6 b")], "item_id long, text string")
    check(docs, items)


def test_edge_rows(edge, empty, spark):
    items = spark.createDataFrame([(1, "one two x y z", "n"), (2, "lorem", "n")], "item_id long, text string, score string")
    check(edge, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert L.ranked_documents(edge, none).count() == 0 and L.ranked_documents(empty, items).count() == 0
    assert L.ranked_documents(empty, none).columns == ["item_id", "rank", "doc_id", "score"]


def test_few_cells_at_a_time(spark, tiny, monkeypatch):
    from quarry.llm.lexical_search import _best  # the block size is read where tasks run; the merge is tested on its own
    import numpy as np
    import pyarrow as pa
    items = L.Items(list(range(20)), [f"t{i} t{i + 1} t{i % 3}" for i in range(20)])
    rng = random.Random(2)
    vec = [np.array([[t, rng.randrange(1, 4)] for t in sorted(rng.sample(range(len(items.terms)), 3))], np.uint32).tobytes() for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"first": pa.array(rng.sample(range(9000), 500)), "m": pa.array([rng.randrange(10, 15) for _ in range(500)]), "vec": pa.array(vec, pa.binary())})
    held = type("B", (), {})
    own, weight = held(), held()
    own.value, weight.value = items, np.arange(1, len(items.terms) + 1)
    outs = []
    for cells in (20 * 7, 1 << 20):
        monkeypatch.setattr(L, "CELLS", cells)
        outs.append([b.to_pydict() for b in _best(own, weight, 4)([batch])])
    assert outs[0] == outs[1]
