"""Revising streams and late joins against their batch twins, whatever the order of arrival."""

import datetime
import random

import pytest

from fathomlake.streaming import revisions

START = datetime.datetime(2024, 1, 1, 12)
NODES = "card string, slot long, says string, payload string, ts timestamp, n long"


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", revisions.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def parts(spark, rows, schema, path, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def gathered(df, path, mode):
    got = []
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(lambda b, _: got.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_are_revised_to_what_the_batch_gives(rocks, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"c{i % 6}", i % 4, rng.choice(["yes", "no", "", None] if i % 6 < 2 else ["yes", "", "yes", None]), f"p{i}", START + datetime.timedelta(seconds=i), i) for i in range(60)]
    rows += [("late", 0, "yes", "first", START, 100), ("late", 1, "no", "then", START + datetime.timedelta(seconds=90), 101)]
    want = {(r.card, r.slot): (r.payload, r.retracted) for r in revisions.settled_verdicts(rocks.createDataFrame(rows, NODES), "card", "slot", "says", "payload", "ts", "n").collect()}
    rng.shuffle(rows)
    given = gathered(revisions.revised_verdicts(parts(rocks, rows, NODES, tmp_path / "in", 5), "card", "slot", "says", "payload", "ts", "n"), tmp_path, "update")
    last = {}
    for r in sorted(given, key=lambda r: r.revision):
        assert r.revision == 1 or (r.payload, r.retracted) != last[r.card, r.slot]
        last[r.card, r.slot] = (r.payload, r.retracted)
    assert last == want and len(given) > len(want)
    assert want["late", 0] == (None, True)


def test_verdict_state_leaves(rocks, tmp_path):
    rows = [("a", 0, "yes", "old", START, 1), ("b", 0, "", "x", START + datetime.timedelta(hours=9), 2), ("b", 1, "", "x", START + datetime.timedelta(hours=18), 3), ("b", 2, "", "x", START + datetime.timedelta(hours=27), 4), ("b", 3, "no", "x", START + datetime.timedelta(hours=27), 5)]
    for i, r in enumerate(rows):
        rocks.createDataFrame([r], NODES).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = rocks.readStream.schema(NODES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    given = gathered(revisions.revised_verdicts(stream, "card", "slot", "says", "payload", "ts", "n", seconds=60), tmp_path, "update")
    assert [r.payload for r in given if r.card == "a"] == ["old"] and all(r.revision == 1 for r in given)


RESULTS, CONTENTS = "url string, n long, shown timestamp", "url string, arrived timestamp, text string"


def test_late_content(spark, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    results = [("a", 1, at(0)), ("b", 2, at(5)), ("c", 3, at(10)), ("d", 4, at(20)), (None, 5, at(30)), ("z", 9, at(9000))]
    contents = [("a", at(60), "in time"), ("b", at(-20), "early"), ("c", at(500), "too late"), ("d", at(-60), "too early"), ("a", at(100), "again"), ("x", at(9000), "no result"), (None, at(31), "no key")]
    batch = revisions.late_content(spark.createDataFrame(results, RESULTS), spark.createDataFrame(contents, CONTENTS), "url", "shown", "arrived")
    want = sorted((r.n, r.text or "") for r in batch.collect())
    assert want == [(1, "again"), (1, "in time"), (2, "early"), (3, ""), (4, ""), (5, ""), (9, "")]
    left, right = parts(spark, results, RESULTS, tmp_path / "r", 2), parts(spark, contents, CONTENTS, tmp_path / "c", 3)
    got = gathered(revisions.late_content(left, right, "url", "shown", "arrived"), tmp_path, "append")
    assert sorted((r.n, r.text or "") for r in got) == [w for w in want if w[0] != 9]
