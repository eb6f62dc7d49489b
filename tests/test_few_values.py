"""Bounded sets of values: exact within the limit, and cheap beyond it."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import prepare as PR
from quarry.operators.profile import few_values


@pytest.fixture(scope="module")
def mixed(spark):
    x = F.col("id")
    return spark.range(0, 6000, 1, 12).select(
        x.alias("unique"), F.when(x % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (x % 50).cast("string"))).alias("of_51"),
        F.when(x % 2 == 0, F.concat(F.lit("é"), (x % 10).cast("string"))).alias("five"), F.lit(None).cast("string").alias("none"),
        (x % 3 / 2).alias("num"), F.when(x == 5999, "z").otherwise("").alias("rare"))


def brute(df, c):
    return sorted((r[0] for r in df.select(F.col(c).cast("string")).distinct().collect() if r[0] is not None), key=str.encode)


def test_equal_to_distinct_within_the_limit(mixed):
    df = mixed
    got = few_values(df, df.columns, 50)
    whole = {c: brute(df, c) for c in df.columns}
    assert got == {c: v if len(v) <= 50 else None for c, v in whole.items()}
    assert got["unique"] is None and got["none"] == [] and got["rare"] == ["", "z"]
    k = len(whole["of_51"])
    assert few_values(df, ["of_51"], k)["of_51"] == whole["of_51"] and few_values(df, ["of_51"], k - 1)["of_51"] is None


def test_empty_table_and_no_columns(mixed):
    assert few_values(mixed.limit(0), ["unique", "five"], 3) == {"unique": [], "five": []}
    assert few_values(mixed, [], 3) == {}


def test_shuffle_does_not_grow_with_the_values(spark):
    """A column of unique values sends limit + 1 rows a task."""
    seen = []
    df = spark.range(0, 100_000, 1, 8).select(F.col("id").cast("string").alias("u"))
    cls = type(df)
    kept = cls.dropDuplicates

    def watched(self, *a, **k):
        seen.append(self.count())
        return kept(self, *a, **k)
    cls.dropDuplicates = watched
    try:
        assert few_values(df, ["u"], 50) == {"u": None}
    finally:
        cls.dropDuplicates = kept
    assert seen == [8 * 51]


@pytest.mark.parametrize("null_code", [None, -1])
def test_codes_equal_those_of_the_join(mixed, null_code):
    df = mixed.select("unique", "five")
    vals = few_values(df, ["five"], 50)["five"]
    key = lambda d: sorted((r["unique"], r["code"]) for r in d.select("unique", F.coalesce("code", F.lit(-9)).alias("code")).collect())
    assert key(PR.label_codes(df, "five", vals, "code", null_code)) == key(PR.label_encode(df, "five", "code", null_code))
    assert PR.label_codes(df, "five", vals).columns == df.columns


def test_prepared_table_takes_its_values_from_one_pass(mixed, monkeypatch):
    from quarry.operators import profile as P
    calls, own = [], P.few_values
    monkeypatch.setattr(P, "few_values", lambda *a: (calls.append(a[2]), own(*a))[1])
    df = mixed.select("unique", "five", "of_51", (F.col("unique") % 7).cast("string").alias("seven"))
    out, report = PR.process_features(df, target="unique")
    assert calls == [2, 10, 50]  # flags to merge (F1), columns to clip (F4), then all that encoding and scaling ask
    assert report["encoding"]["seven"] == "label" and report["encoding"]["five"] in ("one_hot", "label")
    assert {r[0] for r in out.select("seven").distinct().collect()} and out.count() == 6000
