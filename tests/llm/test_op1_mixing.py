from collections import Counter, defaultdict

from llm.helpers import EDGE, SCHEMA, SPACED, TINY, rows
from oracle_harness import canon, duck

from quarry.llm import mixing as M


def water(sizes, share=1.5, most=2):
    """Targets by resharing the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if t[s] > most * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: most * sizes[s] for s in over}


def judge(docs, got):
    sizes = Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len(SPACED.findall(t or ""))
    want = water(sizes)
    taken = defaultdict(int)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted(
        (d is None, d or 0, len(SPACED.findall(t or ""))) for d, t, _, _, _ in docs)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(r["passes"])
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1


def test_targets_and_takings(spark, tiny, edge, empty):
    for df in (tiny, edge):
        docs = [tuple(r) for r in df.collect()]
        for block in (3, 1024):
            judge(docs, rows(M.mix(M.sized(df), block_words=block)))
    assert M.mix(M.sized(empty)).count() == 0
    blank = spark.createDataFrame(EDGE[:3], SCHEMA)
    assert [(r["target"], r["taken"]) for r in rows(M.mix(M.sized(blank)))] == [(0, 0)] * 3


def test_query_equals_oracle(spark):
    from quarry.llm.queries import ORACLE, QUERIES
    a = QUERIES["op1_mixing"](spark, TINY).toPandas()
    assert canon(a) == canon(duck(TINY).sql(ORACLE["op1_mixing"]).df())


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([(0, 5000.0), (1, 2000.0), (2, 999.6), (3, 0.0), (4, 1.0)], "code int, target double")
    got = sorted((r["slot"], r["code"], r["rank"]) for r in rows(M.schedule(spark, goals, 10)))
    assert Counter(c for _, c, _ in got) == {0: 500, 1: 200, 2: 100, 4: 1}
    seen = Counter()
    for i, (_, c, rank) in enumerate(got):
        assert rank == seen[c]
        seen[c] += 1
        assert abs(seen[0] - (i + 1) * 500 / 801) < 6


def test_mixed_documents(spark, tiny, edge):
    for df in (tiny, edge.withColumnRenamed("lang", "size")):
        plan = rows(M.mix(M.sized(df), block_words=64))
        out = M.mixed(df, block_words=64)
        assert out.columns == df.columns
        words = Counter()
        for r in out.collect():
            words[(r.doc_id, r.source)] += len(SPACED.findall(r.text))
        want = Counter()
        for r in plan:
            want[(r["doc_id"], r["source"])] += r["taken"]
        assert +want == words


def test_slots_and_pieces_follow_the_schedule(spark, tiny, edge):
    for df, block in ((tiny, 64), (edge, 5)):
        plan = rows(M.mix(M.sized(df), block_words=block))
        assert all(sum(p.words for p in r["slots"]) == r["taken"] for r in plan)
        assert all(sum(p.words for p in r["slots"] if p["pass"] == e) == n for r in plan for e, n in enumerate(r["passes"]))
        out = rows(M.pieces(df, block_words=block))
        keys = lambda x: sorted(x, key=str)
        assert keys((r["slot"], r["at"], r["words"], r["doc_id"]) for r in out) == keys(
            (p.slot, p.at, p.words, r["doc_id"]) for r in plan for p in r["slots"])
        assert all(len(SPACED.findall(r["text"])) == r["words"] for r in out)
        out.sort(key=lambda r: (r["slot"], r["at"]))
        full, left = Counter(), {r["source"]: round(r["target"]) for r in plan}
        source = {}
        for r in out:  # blocks have no gap; one source each; only a source's last block is short
            assert source.setdefault(r["slot"], r["source"]) == r["source"] and r["at"] == full[r["slot"]]
            full[r["slot"]] += r["words"]
        for slot, n in sorted(full.items()):
            assert n == min(block, left[source[slot]])
            left[source[slot]] -= n
        assert not any(left.values())
        # at every point of the mix each source has its share of the blocks
        order, seen, blocks = [source[x] for x in sorted(full)], Counter(), Counter(source.values())
        for i, x in enumerate(order, 1):
            seen[x] += 1
            assert all(abs(seen[x] - i * n / len(order)) < 8 for x, n in blocks.items())
        text, readings = {r.doc_id: r.text for r in df.collect()}, defaultdict(str)
        for r in sorted(out, key=lambda r: (r["pass"], r["first_word"])):
            readings[(r["doc_id"], r["source"], r["pass"])] += r["text"]
        assert all(text[d].startswith(t) for (d, _, _), t in readings.items() if d != 6)
    assert M.pieces(df.limit(0)).count() == 0
