"""The collated result of a whole analysis."""

import numpy as np
import pytest

from quarry.plans.analysis import complete_analysis


@pytest.fixture(scope="module")
def result(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        x, z = float(rng.normal()), float(rng.normal())
        rows.append((i, x, z, 3 * x - z + 0.1 * float(rng.normal()), "north" if x > 0 else "south"))
    df = spark.createDataFrame(rows, "row_id long, x double, z double, y double, side string")
    return complete_analysis(df, key="row_id", target="y", forge=True, model=True, tune=False)


def test_models_reach_insights_and_headline(result):
    best = result["model_best"].first()
    assert best["rank_score"] > 0.9  # a linear target
    ids = {r["category"]: r["subject"] for r in result["insights"].collect()}
    assert ids["model"] == best["model"]
    assert "deploy_model" in {r["rule"] for r in result["recommendations"].collect()}
    assert {r["metric"]: r["value"] for r in result["headline"].collect()}["best_model"] == best["model"]
    assert result["model_metrics"].count() > 1 and result["model_health"].count() > 1


def test_forge_and_charts_are_rows(result):
    steps = {r["step"] for r in result["forge"].collect()}
    assert {"interactions", "encoding", "selection"} <= steps
    assert set(result["forged"].columns) > {"x", "z"} and result["forged"].count() == 240
    charts = result["charts"].collect()
    assert sum(r["value"] for r in charts if r["chart"] == "histogram" and r["series"] == "x") == 240
    assert {r["label"] for r in charts if r["chart"] == "pie"} == {"north", "south"}
    assert result["digest"].first()["best_silhouette"] is None  # no segments were asked for
