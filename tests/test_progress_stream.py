"""Run progress: state that ends, late events, and the batch table as the measure."""

import datetime as dt
import os

import pytest

from quarry.operators.insight import run_progress
from quarry.streaming import status

SCHEMA = "file_id long, stage string, status string, ts timestamp, event_id long"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


FILES = [
    [(1, "file_structure", "completed", at(0), 1), (2, "file_structure", "completed", at(0), 2), (2, "eda", "failed", at(0, 1), 3)],
    [(2, "eda", "completed", at(1), 4), (3, "full_analysis", "completed", at(20), 5)],   # moves the watermark to day 19
    [(1, "eda", "completed", at(1), 6), (3, "eda", "completed", at(21), 7), (None, "eda", "completed", at(21), 8)],   # 6 is late
    [(2, "full_analysis", "completed", at(22), 9), (2, "full_analysis", "completed", at(22), 9), (4, "eda", "failed", at(22), 10)],
    [(5, "eda", "completed", at(60), 11)],
]


@pytest.fixture(scope="module")
def drained(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    for i, rows in enumerate(FILES):
        path = f"{folder}/{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
        part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.link(f"{path}/{part}", f"{folder}/in-{i}.parquet")
        os.utime(f"{folder}/in-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    events = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "in-*.parquet")
              .parquet(folder))
    rows = status.drain(events, watermark="1 day", idle="7 days")
    return rows.collect(), status.latest(rows).collect()


def test_equals_the_batch_table(spark, drained):
    flat = [r for f in FILES for r in f if r[0] is not None]
    batch = run_progress(spark.createDataFrame(flat, SCHEMA)).collect()
    key = lambda rows: sorted(tuple(sorted(r.asDict().items())) for r in rows)
    assert key(drained[1]) == key(batch)


def test_states_end_and_late_events_leave_apart(drained):
    rows = drained[0]
    gone = {(r["file_id"], r["file_structure"], r["eda"], r["full_analysis"]) for r in rows if r["kind"] == "expired"}
    assert {(1, 1, 0, 0), (2, 1, 1, 0)} <= gone  # both were idle for over seven days when file 3 came
    assert {(3, 0, 1, 1)} <= gone
    late = [(r["file_id"], r["eda"]) for r in rows if r["kind"] == "late"]
    assert late == [(1, 1)]
    anew = max((r for r in rows if r["file_id"] == 2 and r["kind"] == "update"), key=lambda r: r["epoch"])
    assert (anew["file_structure"], anew["eda"], anew["full_analysis"]) == (0, 0, 1)  # the old state is gone


def test_spans():
    assert status._millis("2 hours") == 7_200_000 and status._millis("1 day") == 86_400_000
    with pytest.raises(ValueError):
        status._millis("soon")
