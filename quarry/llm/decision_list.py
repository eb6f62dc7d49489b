"""Quality rules: base limits and a learned decision list.

Sequential covering: on labelled statistics a conjunction of thresholds is grown condition by condition
(by information gain over the rows not yet covered), pruned on rows kept aside, and added to the list
if it is precise there; the rows it covers leave and the next rule grows. The list becomes one ordered
Spark conditional expression: the first rule that holds gives the verdict, else the row is kept.

Rules are learned on the driver from at most ``most`` labelled rows (20,000 unless set, the least by a
hash of the id); statistics and verdicts cover all rows.

Defined cases: a null or empty text has counts of 0 and fails the base limits; without labels of both
kinds the list is empty and only the base limits decide; repeated and null ids are independent rows;
extra columns are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.stats import INPUTS, conjunction, holds, learning_sample, thresholds, with_stats
from quarry.llm.store import materialize

MOST_RULES, MOST_CONDITIONS, BINS = 12, 3, 40
#: Precision that a rule must reach on the rows kept aside, and the rows it must cover there.
PRECISION, COVERS = 0.8, 3
LEARN_ROWS = 20_000


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray]) -> tuple:
    """A conjunction that singles out bad rows: at each step the condition of the largest gain."""
    rule, rows = (), np.arange(len(x))
    while len(rule) < MOST_CONDITIONS:
        p, n = bad[rows].sum(), len(rows)
        if p == n or p == 0:
            break
        best, before = (1e-9, None), np.log2(p / n)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            code = np.searchsorted(cut, x[rows, f], side="left")
            many = np.bincount(code, minlength=len(cut) + 1).cumsum()[:-1]
            hits = np.bincount(code, weights=bad[rows], minlength=len(cut) + 1).cumsum()[:-1]
            for above, m, h in ((False, many, hits), (True, n - many, p - hits)):
                gain = np.where(h > 0, h * (np.log2(np.maximum(h, 1e-9) / np.maximum(m, 1)) - before), 0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), (f, above, float(cut[i])))
        if best[1] is None:
            break
        rule += (best[1],)
        rows = rows[holds((best[1],), x[rows])]
    return rule


def _worth(rule: tuple, x: np.ndarray, bad: np.ndarray) -> float:
    got = holds(rule, x)
    p = bad[got].sum()
    return (p - (got.sum() - p)) / max(got.sum(), 1) if got.any() else -1.0


def _prune(rule: tuple, x: np.ndarray, bad: np.ndarray) -> tuple:
    """The rule without the conditions that do not pay on rows kept aside."""
    while len(rule) > 1:
        shorter = max((rule[:i] + rule[i + 1:] for i in range(len(rule))), key=lambda r: _worth(r, x, bad))
        if _worth(shorter, x, bad) < _worth(rule, x, bad):
            break
        rule = shorter
    return rule


def learn(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Ordered rules (tuples of (input, above, cut)) that reject; y: 1 good, 0 bad."""
    bad = (np.asarray(y) == 0).astype(float)
    if not len(bad) or bad.min() == bad.max():
        return []
    aside = np.arange(len(bad)) % 3 == 2
    grow, test, cuts, rules = ~aside, aside, thresholds(x, BINS), []
    while len(rules) < MOST_RULES and bad[grow].sum() > 0:
        rule = _grow(x[grow], bad[grow], cuts)
        if not rule:
            break
        rule = _prune(rule, x[test], bad[test])
        got = holds(rule, x)
        seen = got & test
        covers = got & grow
        if not covers.any():
            break
        if seen.sum() >= COVERS and bad[seen].mean() >= PRECISION and bad[covers].mean() >= PRECISION:
            rules.append(rule)
            test = test & ~got
            grow = grow & ~got
        else:
            grow = grow & ~(covers & (bad == 1))  # its bad rows would only grow it again
    return rules


def verdict(rules: list[tuple]) -> Column:
    """True (keep) unless a rule holds: an ordered conditional expression."""
    out = None
    for r in rules:
        out = F.when(conjunction(r), F.lit(False)) if out is None else out.when(conjunction(r), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fired(rules: list[tuple]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(conjunction(r), F.lit(i)) if out is None else out.when(conjunction(r), F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def say(rules: list[tuple]) -> str:
    one = lambda r: " and ".join(f"{INPUTS[f]} {'>' if a else '<='} {c:.4g}" for f, a, c in r)
    return "\n".join([f"{i}. reject if {one(r)}" for i, r in enumerate(rules, 1)] + ["else keep"])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
                  most: int = LEARN_ROWS) -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule
    (the learned rule that rejects it, if any) and kept."""
    stats, names = with_stats(docs, [id_col], text_col)
    stats = materialize(stats, "stats")
    x, y, _ = learning_sample(stats, labels, label, names[0], most=most)
    rules = learn(x, y)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(F.col(names[0]).alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), fired(rules).alias("rule"), (~failed & verdict(rules)).alias("kept"))
