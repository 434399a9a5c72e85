"""Keyed tables kept by streams: upserts by buckets with a ledger, and change events whose state expires."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ledger(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """The newest version of each bucket; one row a bucket passes the driver."""
    try:
        rows = spark.read.parquet(f"{target}/ledger")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return {}
    rows = rows if before is None else rows.where(F.col("version") < before)
    return {r.bucket: r.version for r in rows.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def _rows_of(spark: SparkSession, target: str, versions: dict[int, int]) -> DataFrame:
    """The rows of these buckets' versions; other folders are pruned."""
    newest = F.element_at(F.create_map(*[F.lit(x) for kv in versions.items() for x in kv]), F.col("_bucket"))
    rows = spark.read.option("basePath", f"{target}/data").parquet(*[f"{target}/data/_version={v}" for v in sorted(set(versions.values()))])
    return rows.where(F.col("_bucket").isin(list(versions)) & (F.col("_version") == newest)).drop("_bucket", "_version")


def upsert_batch(rows: DataFrame, key: str, target: str, order: str, number: int, buckets: int = 64) -> None:
    """Merge a batch into target: one row a key, that of greatest order (ties: the greatest row by its other columns' names; null orders are least).

    Keys are dealt over buckets by hash. Only the buckets that the batch touches are read and written, as
    folders of this batch's version; the ledger, written last, makes them current. A batch that is
    repeated starts from the versions before it and writes the same folders anew; one that was cut off
    leaves the old versions current. Rows of a null key are one key. Old versions stay until vacuum.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r["_bucket"] for r in dealt.select("_bucket").distinct().collect()]
    if not touched:
        return
    held = {b: v for b, v in _ledger(spark, target, number).items() if b in touched}
    if held:
        dealt = dealt.unionByName(_rows_of(spark, target, held).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    names = [c for c in rows.columns if c != key]
    best = dealt.groupBy("_bucket", key).agg(F.max_by(F.struct(*names), F.struct(order, *sorted(names))).alias("_r")).select("_bucket", key, *[F.col("_r")[c].alias(c) for c in names])
    best.write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/data/_version={number}")
    spark.createDataFrame([(b, number) for b in touched], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/ledger/batch={number}")


def upsert_stream(stream: DataFrame, key: str, target: str, checkpoint: str, order: str, buckets: int = 64) -> None:
    """Run the stream's waiting batches into target by upsert_batch."""
    stream.writeStream.foreachBatch(lambda batch, number: upsert_batch(batch, key, target, order, number, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, target: str) -> DataFrame | None:
    """The target's rows as of its ledger; None before the first batch."""
    versions = _ledger(spark, target)
    return _rows_of(spark, target, versions) if versions else None


class _Changes(StatefulProcessor):
    """The last state of a key and its time; both go after ``keep`` milliseconds of event time without rows."""

    def __init__(self, key: str, time: str, order: list[str], state: str, keep: int):
        self.key, self.time, self.order, self.state, self.keep = key, time, order, state, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        frame = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        columns = {c: frame[c].to_numpy() for c in (self.time, *self.order, self.state)}
        if any(columns[c].dtype == object for c in self.order):
            taken = frame.sort_values([self.time, *self.order]).index.to_numpy()
        else:
            taken = np.lexsort([columns[c] for c in (*reversed(self.order), self.time)])
        held = self.last.get()
        state, at = held or (None, None)
        if at is not None:
            # others are late: a newer state is known already
            taken = taken[~(columns[self.time][taken] < pd.Timestamp(at).to_datetime64())]
        if not len(taken):
            return
        new = columns[self.state][taken].tolist()
        old = [state, *new[:-1]]
        there = np.array([b is not None and a != b for b, a in zip(old, new, strict=True)])
        changed = taken[there]
        if len(changed):
            yield pd.DataFrame({self.key: [key[0]] * len(changed), **{c: columns[c][changed] for c in (self.time, *self.order)}, "from_state": [b for b, t in zip(old, there, strict=True) if t], "to_state": [a for a, t in zip(new, there, strict=True) if t]})
        state, at = new[-1], pd.Timestamp(columns[self.time][taken[-1]])
        if held is None or (state, at) != (held[0], pd.Timestamp(held[1])):
            # a key without state has no timer
            for timer in self.handle.listTimers() if held else ():
                self.handle.deleteTimer(timer)
            self.last.update((state, at.to_pydatetime()))
            self.handle.registerTimer(max(int(at.timestamp() * 1000) + self.keep, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_changes(stream: DataFrame, key: str, time: str, order: list[str], state: str, late: str = "0 seconds", keep: str = "365 days") -> DataFrame:
    """(key, time, order..., from_state, to_state) where a key's state differs from the one before, by event time.

    A key's last state is kept until the watermark (``late`` behind the newest row) passes ``keep`` after
    its last row; then a timer clears it, and the key's next row starts anew without an event. Rows behind
    the watermark are dropped; rows older than the key's kept state are late, too, and change nothing.
    Rows of equal time are taken by the order columns. A null key is a key; a null state is a state that
    gives no event by itself. Rows of a batch meet by key, so a key with very many rows in one batch is
    one task's; bound batches by the source's options. Needs the RocksDB state store, which is set here.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in (key, time, *order))
    span = int(pd.Timedelta(keep).total_seconds() * 1000)
    processor = _Changes(key, time, order, state, span)
    # only what the processor reads goes to Python
    return stream.select(*dict.fromkeys([key, time, *order, state])).withWatermark(time, late).groupBy(key).transformWithStateInPandas(processor, f"{fields}, from_state string, to_state string", "append", "eventTime")


def vacuum_list(spark: SparkSession, target: str) -> list[str]:
    """Folders of target that no reader of the ledger needs any more: versions of which no bucket is current. Deleting them is the caller's."""
    current = set(_ledger(spark, target).values())
    written = {r.version for r in spark.read.parquet(f"{target}/ledger").select("version").distinct().collect()}
    return [f"{target}/data/_version={v}" for v in sorted(written - current)]
