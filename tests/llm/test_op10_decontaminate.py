import hashlib

from llm.helpers import LETTERED, TINY, by_id, lower, rows

from quarry.llm.decontaminate import decontaminated, verbatim_matches


def words(t):
    return LETTERED.findall(lower(t))


def brute(docs, items, window=10):
    wins = []
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        wins += [(i, tuple(w[a:a + k])) for a in range(len(w) - k + 1) if k]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        at = {}
        for k in {len(x) for _, x in wins}:
            for a in range(len(w) - k + 1):
                at.setdefault(tuple(w[a:a + k]), []).append(a)
        for i, x in wins:
            for a in at.get(x, ()):
                ids.add("" if i is None else str(i))
                hit.update(range(a, a + len(x)))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


def test_matches_brute_force(spark, tiny):
    bench = spark.read.parquet(f"{TINY}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in tiny.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(verbatim_matches(tiny, bench, ["doc_id"])) == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)
    assert got(verbatim_matches(tiny, bench, ["doc_id"], block_bytes=1500)) == want  # several passes


def test_edge_cases(spark, edge, empty):
    items = [(1, "one"), (1, "x y"), (2, None), (3, ""), (None, "no id here"), (4, "lorem ipsum dolor sit amet consectetur lorem ipsum dolor sit amet"),
             (5, "ÜNÏ cödé"), (5, "Ünï cödé ß")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    assert got(verbatim_matches(edge, bench, ["doc_id"])) == brute(docs, items)
    assert got(verbatim_matches(edge, bench.limit(0), ["doc_id"])) == brute(docs, [])
    assert verbatim_matches(empty, bench, ["doc_id"]).count() == 0


def test_longest_match_and_removal(spark):
    docs = spark.createDataFrame([(1, "zz a b c d e f g h i j k l yy", "t"), (2, "a b c d", "u")], "doc_id long, text string, contaminated string")
    bench = spark.createDataFrame([(7, "q a b c d e f g h i j k l")], "item_id long, text string")
    r = by_id(verbatim_matches(docs, bench, ["doc_id"]))
    assert [tuple(m) for m in r[1]["matches"]] == [("7", 1, 1, 12)] and r[1]["longest_match"] == 12
    assert rows(decontaminated(docs, bench)) == [{"doc_id": 2, "text": "a b c d", "contaminated": "u"}]
