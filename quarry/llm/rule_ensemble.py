"""Quality classifier: a sparse ensemble of rules.

Small boosted trees are grown on statistics of labelled texts; every path from a root to a node is a
conjunction of thresholds. Logistic regression with a lasso penalty weighs the rules and leaves few.
The result is one Spark column expression over the statistics, which scores all rows.

The trees and weights are fitted on the driver on at most ``most`` labelled rows (20,000 unless set,
the least by a hash of the id). Held-out rows never enter.

Defined cases: a null or empty text has statistics of 0 and gets the score they give; no rules are learned from
fewer than LEAST_LABELS labelled rows, or from labels of one kind: every score is then the labels' mean (0.5
without any, kept within 0.01 and 0.99), and ``accepted`` keeps all rows, as nothing tells good from bad; a null doc_id
is not held out and cannot be learned from; a document labelled twice has its majority, one id with several texts
the least statistics among them; extra columns are ignored or kept."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.stats import INPUTS, conjunction, holds, learning_sample, thresholds, with_stats
from quarry.llm.store import materialize

TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
LASSO, STEPS = 0.001, 600
LEARN_ROWS = 20_000
#: Labelled rows below which no rules are learned.
LEAST_LABELS = 10
KEEP_SCORE = 0.7


def _split(codes: np.ndarray, sizes: list[int], rows: np.ndarray, residual: np.ndarray, least: int):
    """Best (gain, feature, bin) of one node: the largest drop of squared error."""
    best = (1e-9, -1, -1)
    n, total = len(rows), residual[rows].sum()
    for f, k in enumerate(sizes):
        if k < 2:
            continue
        c = codes[rows, f]
        many = np.cumsum(np.bincount(c, minlength=k))[:-1]
        left = np.cumsum(np.bincount(c, weights=residual[rows], minlength=k))[:-1]
        ok = (many >= least) & (n - many >= least)
        gain = np.where(ok, left ** 2 / np.maximum(many, 1) + (total - left) ** 2 / np.maximum(n - many, 1) - total ** 2 / n, 0)
        b = int(gain.argmax())
        if gain[b] > best[0]:
            best = (float(gain[b]), f, b)
    return best


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Paths of boosted trees as rules: tuples of (input, above, cut)."""
    cuts = thresholds(x, BINS)
    codes = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    sizes = [len(c) + 1 for c in cuts]
    least = max(3, len(y) // 400)
    logit = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, None] = {}
    for t in range(TREES):
        residual = y - 1 / (1 + np.exp(-logit))
        half = np.flatnonzero((np.arange(len(y)) * 2654435769 + t * 40503) % 997 < 700)
        leaves, open_ = [], [((), half)]
        for _ in range(DEPTH):
            nodes, open_ = open_, []
            for path, rows in nodes:
                gain, f, b = _split(codes, sizes, rows, residual, least)
                if f < 0:
                    leaves.append((path, rows))
                    continue
                left = codes[rows, f] <= b
                for above, part in ((False, rows[left]), (True, rows[~left])):
                    step = path + ((f, above, float(cuts[f][b])),)
                    rules[_short(step)] = None
                    open_.append((step, part))
        for path, rows in leaves + open_:
            if path:
                p = 1 / (1 + np.exp(-logit[rows]))
                logit = logit + RATE * holds(path, x) * residual[rows].sum() / max((p * (1 - p)).sum(), 1e-3)
    return list(rules)


def _short(rule: tuple) -> tuple:
    """Of several bounds on one side of an input only the tightest, in a fixed order."""
    tight = {}
    for f, above, cut in rule:
        old = tight.get((f, above), cut)
        tight[(f, above)] = max(cut, old) if above else min(cut, old)
    return tuple(sorted((f, above, cut) for (f, above), cut in tight.items()))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient on standardised columns."""
    mean, dev = r.mean(axis=0), np.maximum(r.std(axis=0), 1e-9)
    z = (r - mean) / dev
    lipschitz = 0.25 * max(np.linalg.norm(z, 2) ** 2 / len(z), 1e-9) + 0.25
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ v + c))) - y
        w1 = v - z.T @ g / len(y) / lipschitz
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - penalty / lipschitz, 0)
        b1 = c - g.mean() / lipschitz
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    w = w / dev
    return float(b - mean @ w), w


class RuleModel:
    """Weighted rules; ``score`` is their Spark column."""

    def __init__(self, intercept: float, rules: list[tuple], weights: list[float]):
        self.intercept, self.rules, self.weights = intercept, rules, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "RuleModel":
        if len(y) < LEAST_LABELS or y.min() == y.max():
            share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
            return cls(float(np.log(share / (1 - share))), [], [])
        seen, rules = set(), []
        for rule in tree_rules(x, y):
            mark = holds(rule, x).tobytes()
            if mark not in seen:
                seen.add(mark)
                rules.append(rule)
        r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(float)
        b, w = lasso_logistic(r, y, LASSO, STEPS)
        keep = np.flatnonzero(np.abs(w) > 1e-6)
        return cls(b, [rules[i] for i in keep], [float(w[i]) for i in keep])

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(conjunction(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))

    def __str__(self) -> str:
        say = lambda r: " and ".join(f"{INPUTS[f]} {'>' if a else '<='} {c:.4g}" for f, a, c in r)
        return "\n".join([f"{self.intercept:+.3f}", *[f"{w:+.3f} if {say(r)}" for r, w in zip(self.rules, self.weights)]])


def held_out(id_col: str) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
        most: int = LEARN_ROWS) -> tuple[RuleModel, DataFrame]:
    """The model, learned from rows that are not held out, and the written statistics of all rows."""
    stats, names = with_stats(docs, [id_col], text_col)
    stats = materialize(stats, "stats")
    x, y, _ = learning_sample(stats.filter(~held_out(names[0])), labels, label, names[0], most=most)
    return RuleModel.fit(x, y), stats


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label: str = "quality", most: int = LEARN_ROWS) -> DataFrame:
    """Per row: the id, held_out, score and predicted (1 from KEEP_SCORE on)."""
    model, stats = fit(docs, labels, id_col, text_col, label, most)
    return (stats.select(F.col("k0").alias(id_col), held_out("k0").alias("held_out"), model.score().alias("score"))
            .withColumn("predicted", (F.col("score") >= KEEP_SCORE).cast("int")))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label: str = "quality", most: int = LEARN_ROWS) -> DataFrame:
    """The rows predicted good, or all rows where no rules could be learned; columns as given."""
    model, _ = fit(docs, labels, id_col, text_col, label, most)
    if not model.rules:
        return docs
    rows, names = with_stats(docs, docs.columns, text_col, with_text=True)
    return rows.filter(model.score() >= KEEP_SCORE).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
