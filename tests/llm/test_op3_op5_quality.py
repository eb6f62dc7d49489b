import zlib
from collections import Counter

import numpy as np
import pytest
from llm.helpers import SPACED, TINY, by_id, rows

from quarry.llm import decision_list as D
from quarry.llm import rule_ensemble as R
from quarry.llm.stats import INPUTS, holds

SMALL = "/root/testdata/sf0.01"


def brute(t):
    t = t or ""
    w = SPACED.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    again = {i + j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    n, r = len(w), len(again)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_op5_counts_equal_brute_force(tiny, edge, empty, labels):
    for df in (tiny, edge):
        got = sorted(((r["doc_id"], *[r[c] for c in COLS]) for r in rows(D.quality_rules(df, labels))), key=str)
        assert got == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=str)
    assert D.quality_rules(empty, labels).count() == 0


def test_op5_list_separates_and_base_wins(small, labels):
    got = by_id(D.quality_rules(small, labels))
    assert all(not r["kept"] for r in got.values() if r["base_failed"])
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] is None) for r in got.values())
    truth = [(r["quality"], got[r["doc_id"]]) for r in rows(labels)]
    judged = [(y, r["rule"] is None) for y, r in truth]
    assert np.mean([y == k for y, k in judged]) > 0.97


def test_op5_without_labels(small, labels):
    got = rows(D.quality_rules(small, labels.limit(0)))
    assert all(r["kept"] == (not r["base_failed"]) for r in got)


def test_rules_and_expressions_agree(spark, small, labels):
    model, stats = R.fit(small, labels)
    x = np.array([[float(r[c]) for c in INPUTS] for r in stats.select(*INPUTS).collect()])
    s = np.array([r[0] for r in stats.select(model.score()).collect()])
    assert np.allclose(s, model.score_rows(x))
    y = (model.score_rows(x) > 0.5).astype(int)
    rules = D.learn(x, y)
    rejected = np.any([holds(r, x) for r in rules], axis=0)
    assert rules and [not r[0] for r in stats.select(D.verdict(rules)).collect()] == rejected.tolist()
    assert "if" in str(model) and "else keep" in D.say(rules)


def test_op3_held_out_accuracy(small, labels, edge, empty):
    got = by_id(R.quality_scores(small, labels))
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    truth = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in rows(labels) if got[r["doc_id"]]["held_out"]]
    assert len(truth) > 60 and np.mean([a == b for a, b in truth]) > 0.93
    on_edge = rows(R.quality_scores(edge, labels))
    assert len(on_edge) == edge.count() and all(0 <= r["score"] <= 1 for r in on_edge)
    assert R.quality_scores(empty, labels).count() == 0


def test_op3_ignores_held_out_labels(spark, small, labels):
    from pyspark.sql import functions as F
    other = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (by_id(R.quality_scores(small, x)) for x in (labels, other))
    assert a == b


def test_op3_without_labels_or_with_odd_ones(spark, tiny, labels):
    assert {r["score"] for r in rows(R.quality_scores(tiny, labels.limit(0)))} == {0.5}
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in rows(R.quality_scores(tiny, odd))}) == 1


def test_accepted_keeps_columns(small, labels):
    from pyspark.sql import functions as F
    docs = small.withColumn("n_words", F.lit("x")).withColumn("score", F.col("doc_id"))
    out = R.accepted(docs, labels)
    good = {d for d, r in by_id(R.quality_scores(small, labels)).items() if r["predicted"]}
    assert out.columns == docs.columns and {r["doc_id"] for r in rows(out)} == good
    assert {r["n_words"] for r in rows(out)} == {"x"} and TINY


@pytest.mark.parametrize("kind", ["empty", "one-sided", "nine", "null"])
def test_without_rules_nothing_is_rejected(spark, tiny, kind):
    ids = [r["doc_id"] for r in tiny.select("doc_id").limit(40).collect()]
    table = {"empty": [], "one-sided": [(i, 0) for i in ids], "nine": [(i, k % 2) for k, i in enumerate(ids[:9])], "null": [(i, None) for i in ids]}[kind]
    labels = spark.createDataFrame(table, "doc_id long, quality int")
    kept = R.accepted(tiny, labels)
    assert kept.columns == tiny.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in tiny.collect())
    assert R.quality_scores(tiny, labels).select("score").distinct().count() == 1


def test_rules_and_weights_against_plain_loops():
    """Every rule is a path of a tree, so no rule's cut lies outside its input's values; the lasso's weights
    are at the minimum: no single weight or the intercept can be moved for a lower loss."""
    rng = np.random.default_rng(4)
    x = rng.random((300, len(INPUTS)))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(int)
    rules = R.tree_rules(x, y)
    assert all(x[:, f].min() < cut < x[:, f].max() for r in rules for f, _, cut in r)
    for r in rules[:40]:
        plain = [all((row[f] > c) if above else (row[f] <= c) for f, above, c in r) for row in x]
        assert holds(r, x).tolist() == plain
    z = np.stack([holds(r, x) for r in rules[:25]], axis=1).astype(float)
    b, w = R.lasso_logistic(z, y, 0.01, 4000)
    dev = z.std(axis=0)

    def loss(b, w):
        p = 1 / (1 + np.exp(-(b + z @ w)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.01 * np.abs(w * np.where(dev > 0, dev, 1)).sum()

    at = loss(b, w)
    for j in range(len(w)):
        for step in (-1e-3, 1e-3):
            other = w.copy()
            other[j] += step
            assert loss(b, other) >= at - 1e-6
    assert min(loss(b + 1e-3, w), loss(b - 1e-3, w)) >= at - 1e-6
