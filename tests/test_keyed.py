"""Streams into keyed tables: repeated and broken batches, late rows, expiry."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.streaming import keyed

SCHEMA = "id long, v string, at int"


def rows_of(df):
    return sorted(((r.id, r.v, r.at) for r in df.collect()), key=str)


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    target = str(tmp_path / "t")
    assert keyed.upserted(spark, target) is None
    first = spark.createDataFrame([(i, "a", 1) for i in range(50)] + [(None, "n", 1)], SCHEMA)
    keyed.upsert_batch(first, "id", target, "at", 0, buckets=16)
    second = spark.createDataFrame([(7, "b", 2), (7, "c", 2), (8, "old", 0), (None, "m", 2), (99, "new", None)], SCHEMA)
    keyed.upsert_batch(second, "id", target, "at", 1, buckets=16)
    want = sorted([(i, "a", 1) for i in range(50) if i != 7] + [(7, "c", 2), (None, "m", 2), (99, "new", None)], key=str)
    assert rows_of(keyed.upserted(spark, target)) == want
    written = spark.read.parquet(f"{target}/data/_version=1").select("_bucket").distinct().count()
    assert written <= 4
    # the batch once more, and an empty one
    keyed.upsert_batch(second, "id", target, "at", 1, buckets=16)
    keyed.upsert_batch(second.limit(0), "id", target, "at", 2, buckets=16)
    assert rows_of(keyed.upserted(spark, target)) == want
    assert keyed.vacuum_list(spark, target) == []
    keyed.upsert_batch(first, "id", target, "at", 3, buckets=16)
    assert rows_of(keyed.upserted(spark, target)) == want
    assert keyed.vacuum_list(spark, target) == [f"{target}/data/_version=0", f"{target}/data/_version=1"]


def test_a_batch_that_was_cut_off_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], SCHEMA)
    keyed.upsert_batch(first, "id", target, "at", 0, buckets=2)
    # files of the next version, without its ledger
    spark.createDataFrame([(1, "broken", 9)], SCHEMA).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{target}/data/_version=1")
    assert rows_of(keyed.upserted(spark, target)) == [(1, "a", 1), (2, "a", 1)]
    keyed.upsert_batch(spark.createDataFrame([(1, "b", 2)], SCHEMA), "id", target, "at", 1, buckets=2)
    assert rows_of(keyed.upserted(spark, target)) == [(1, "b", 2), (2, "a", 1)]


@pytest.mark.parametrize("keep, late", [("10 days", "2 days")])
def test_state_expires_and_late_rows_are_dropped(spark, tmp_path, keep, late):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "k string, at timestamp, n int, state string"
    batches = [
        [("a", day(0), 1, "x"), ("a", day(1), 3, "y"), ("a", day(1), 2, "x"), ("b", day(1), 4, "x"), ("c", day(5), 5, None)],
        [("a", day(6), 6, "y"), ("a", day(5), 7, "z"), ("b", day(0), 8, "q")],  # b's row is behind the watermark, day 3
        [("c", day(6), 9, "x"), ("d", day(40), 10, "x")],
        [("d", day(41), 11, "y")],
        [("a", day(42), 12, "w"), ("b", day(42), 13, "x"), ("d", day(39), 14, "v")],  # a and b are forgotten; d's row is behind its state, day 41
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = keyed.expiring_changes(spark.readStream.schema(schema).parquet(source), "k", "at", ["n"], "state", late, keep)
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", mark).trigger(availableNow=True).start(target).awaitTermination()
    got = sorted((r.k, r.n, r.from_state, r.to_state) for r in spark.read.parquet(target).collect())
    assert got == [("a", 3, "x", "y"), ("a", 6, "z", "y"), ("a", 7, "y", "z"), ("d", 11, "x", "y")]


class _Handle:
    """Counts the calls that a processor makes to its state."""

    def __init__(self, held=None):
        self.held, self.calls, self.timers = held, [], []

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def listTimers(self):  # noqa: N802
        self.calls.append("list")
        return list(self.timers)

    def deleteTimer(self, timer):  # noqa: N802
        self.timers.remove(timer)

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("register")
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_changes_of_a_key_cost_three_calls_at_first():
    at = lambda n: pd.Timestamp(2024, 1, 1 + n)
    handle = _Handle()
    one = keyed._Changes("k", "at", ["n"], "state", 1000)
    one.init(handle)
    frame = lambda *rows: iter([pd.DataFrame(r, columns=["k", "at", "n", "state"]) for r in rows])
    told = lambda rows: [tuple(r) for f in one.handleInputRows(("a",), rows, handle) for r in f.itertuples(index=False)]
    assert told(frame([("a", at(2), 3, "y"), ("a", at(1), 2, "x")], [("a", at(1), 1, None), ("a", at(3), 4, "y")])) == [("a", at(2), 3, "x", "y")]
    assert handle.calls == ["get", "update", "register"] and handle.held[0] == "y"
    assert told(frame([("a", at(2), 9, "q")])) == [] and handle.calls[3:] == ["get"]  # late
    assert told(frame([("a", at(3), 0, "z"), ("a", at(4), 1, None)])) == [("a", at(3), 0, "y", "z"), ("a", at(4), 1, "z", None)]
    assert len(handle.timers) == 1 and handle.held == (None, at(4).to_pydatetime())
    # order columns of text, with missing ones last
    assert told(frame([("a", at(5), None, "u"), ("a", at(5), "b", "t"), ("a", at(5), "a", "s")])) == [("a", at(5), "b", "s", "t"), ("a", at(5), None, "t", "u")]
