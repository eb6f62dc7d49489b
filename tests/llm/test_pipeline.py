import corpus_pipeline as P
from llm.helpers import LETTERED, SPACED, by_id, lower, rows
from llm.test_op6_token_output import expected, got
from llm.test_op9_near_dedup import brute

from quarry.llm import rule_ensemble
from quarry.llm.store import materialize, table

SMALL = "/root/testdata/sf0.01"


def test_every_stage_takes_effect(spark):
    docs = table(spark, SMALL, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in P.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SMALL), f"test-{name}"))
        assert name == "tokens" or kept[-1].columns == columns
    ids = [sorted(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]

    good = {d for d, r in by_id(rule_ensemble.quality_scores(docs, table(spark, SMALL, "labels"))).items() if r["predicted"]}
    assert ids[1] == sorted(good)

    groups = brute([(r.doc_id, r.text) for r in kept[1].collect()], 5)
    assert ids[2] == sorted(d for d, _, _, k in groups if k) and len(ids[2]) < len(ids[1])

    windows = set()
    for r in rows(table(spark, SMALL, "benchmark")):
        w = LETTERED.findall(lower(r["text"]))
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9)) if w}
    def leaks(t):
        w = LETTERED.findall(lower(t))
        return any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))
    assert ids[3] == sorted(r["doc_id"] for r in rows(kept[2]) if not leaks(r["text"])) and len(ids[3]) < len(ids[2])

    words = lambda df: sum(len(SPACED.findall(r["text"])) for r in rows(df))
    assert abs(words(kept[4]) - 1.5 * words(kept[3])) <= 20 and set(ids[4]) <= set(ids[3])

    assert got(kept[5]) == expected([(r["doc_id"], r["text"]) for r in rows(kept[4])])
    assert got(P.run(spark, SMALL)) == got(kept[5])


def test_repeated_rows_leave_one(spark):
    from quarry.llm.near_dedup import deduplicated
    docs = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (None, "a b c d e f", "z"), (None, None, "z"), (3, None, "z"), (4, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, own_id string")
    out = sorted((tuple(r) for r in deduplicated(df).collect()), key=str)
    assert out == sorted([docs[0], *docs[3:]], key=str)
