"""Streams give what their batch twins give."""

import datetime

import pytest

from fathomlake.operators import usage
from fathomlake.streaming import twins

#: The events go on past midnight.
START = datetime.datetime(2024, 1, 1, 23, 57)


@pytest.fixture()
def events(spark, tmp_path):
    """Two files, read one after the other."""
    rows = [(i, START + datetime.timedelta(seconds=37 * i % 400 + 400 * (i // 40)), "abc"[i % 3]) for i in range(80)]
    schema = "event_id long, ts timestamp, key string"
    for n, part in enumerate((rows[:40], rows[40:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    return spark.createDataFrame(rows, schema), stream, tmp_path


def drained(spark, df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.mark.parametrize("name", ["fixed_window", "greedy_spacing", "free_retries"])
def test_folds(spark, events, name):
    batch, stream, path = events
    args = {"fixed_window": (2, 60), "greedy_spacing": (60,), "free_retries": (60, 2)}[name]
    got = drained(spark, getattr(twins, name)(stream, "key", "ts", "event_id", *args), name, path)
    flag = {"fixed_window": "admitted", "greedy_spacing": None, "free_retries": "free_retry"}[name]
    want = getattr(usage, name)(batch, "key", "ts", "event_id", *args)
    want = sorted((r.event_id, r[flag] if flag else True) for r in want.collect())
    assert sorted((r.event_id, r.value) for r in got.collect()) == want


def test_first_seen(spark, events):
    _, stream, path = events
    got = drained(spark, twins.first_seen(stream, ["key"], "ts"), "firsts", path)
    assert got.count() == 3


def test_daily_counts(spark, tmp_path):
    schema = "event_id long, ts timestamp, key string"
    day = lambda d, h, k, i: (i, datetime.datetime(2024, 1, d, h), k)
    rows = [day(1, 1, "a", 1), day(1, 23, "a", 2), day(1, 23, "b", 3), day(2, 0, "a", 4), day(3, 2, "a", 5), day(4, 5, "c", 6)]
    for n, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = drained(spark, twins.daily_counts(stream, "key", "ts"), "days", tmp_path)
    closed = {(r.window.start.day, r.key): r.n for r in got.collect()}
    batch = {(r.day.day, r.key): r.n for r in usage.daily_usage(spark.createDataFrame(rows, schema), "key", "ts").collect()}
    assert closed == {k: n for k, n in batch.items() if k[0] < 4} and len(closed) == 4
