"""Debounce by state and timers: three trees in one stream, with restarts, against sessions of the whole."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from treewarden.streaming.changes import debounced
from treewarden.streaming.debounce import follow_trees, phases

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, before)


def events(seed=4, n=120):
    rng = random.Random(seed)
    at, out = 0, []
    for _ in range(n):
        at += rng.choice([50, 200, 400, 900, 3000])
        out.append((rng.choice("abc"), T0 + datetime.timedelta(milliseconds=at)))
    return out


def test_three_trees_and_restarts(rocks, tmp_path):
    rows = events()
    end = [(r, rows[-1][1] + datetime.timedelta(seconds=60)) for r in "z"]  # moves the watermark beyond all bursts
    table, seen, calls = str(tmp_path / "changes"), [], []
    stream = lambda: rocks.readStream.schema("repo string, at timestamp").parquet(table)

    def keep(batch, number):
        seen.extend((r["repo"], r["at"], r["phase"], r["began"], r["changes"]) for r in batch.collect())

    pieces = [rows[:31], rows[31:32], rows[32:80], rows[80:] + end]
    for piece in pieces:  # a new query, from the checkpoint, for every piece
        rocks.createDataFrame(piece, "repo string, at timestamp").coalesce(1).write.mode("append").parquet(table)
        phases(stream(), 500).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    whole = debounced(rocks.createDataFrame(rows, "repo string, at timestamp"), "500 milliseconds").collect()
    want = sorted((r["repo"], r["quiet_at"], r["began"], r["changes"]) for r in whole)
    assert sorted((r, at, began, n) for r, at, phase, began, n in seen if phase == "scanning") == want
    assert sorted((r, at) for r, at, phase, *_ in seen if phase == "debouncing" and r != "z") == sorted((r["repo"], r["began"]) for r in whole)

    def rescan(repos, number):
        calls.append((number, repos))
        if len(calls) == 1:
            raise OSError("gone")

    with pytest.raises(Exception, match="gone"):
        follow_trees(stream(), 500, str(tmp_path / "ck2"), rescan, once=True).awaitTermination()
    follow_trees(stream(), 500, str(tmp_path / "ck2"), rescan, once=True).awaitTermination()
    assert calls[0] == calls[1] == (0, ["a", "b", "c"])  # the batch that failed is repeated, no other is
    assert len({n for n, _ in calls[1:]}) == len(calls) - 1 and {r for _, repos in calls for r in repos} == {"a", "b", "c"}


def test_time_since_the_phase_before(rocks, tmp_path):
    ms = lambda n: T0 + datetime.timedelta(milliseconds=n)
    rocks.createDataFrame([("a", ms(0)), ("a", ms(100)), ("a", ms(2000)), (None, ms(2100)), ("a", None), ("b", ms(90_000))], "repo string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "t"))
    out = phases(rocks.readStream.schema("repo string, at timestamp").parquet(str(tmp_path / "t")), 500)
    out.writeStream.format("memory").queryName("phases_seen").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [(r["phase"], r["prev_ms"], r["changes"]) for r in rocks.table("phases_seen").where("repo = 'a'").orderBy("at").collect()]
    assert got == [("debouncing", None, 0), ("scanning", 600, 2), ("debouncing", 1400, 0), ("scanning", 500, 1)]
    assert rocks.table("phases_seen").where(F.col("repo").isNull()).count() == 2
