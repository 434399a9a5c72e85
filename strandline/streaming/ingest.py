"""Incremental ingest, idempotent stream upserts and change events with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.components import shared_folder


def ingest_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, kind: str = "parquet") -> None:
    """Append the rows of files that weren't there at the last call; files are known by the checkpoint."""
    stream = spark.readStream.format(kind).schema(schema).load(source)
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


def stream_upsert(spark: SparkSession, source: str, schema: str, key: str, target: str, checkpoint: str, order: str) -> None:
    """Keep one row a key in target (its versions as folders, the newest complete one counting): the one of greatest order.

    A batch that is repeated writes the same version anew, so nothing doubles.
    """

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch
        if number:
            rows = rows.unionByName(session.read.parquet(f"{target}/v{number - 1}"))
        names = [c for c in batch.columns if c != key]
        best = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(order, *sorted(names))).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in names])
        best.write.mode("overwrite").parquet(f"{target}/v{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_version(spark: SparkSession, target: str, checkpoint: str) -> DataFrame:
    """The target's rows after the last batch committed under checkpoint (whose commits are files named by number)."""
    files = spark.read.format("binaryFile").load(f"{checkpoint}/commits").select(F.regexp_extract("path", r"/(\d+)$", 1).alias("n"))
    last = files.where("n <> ''").agg(F.max(F.col("n").cast("long"))).first()[0]
    return spark.read.parquet(f"{target}/v{last}")


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(window_start, key, n) of tumbling windows; rows later than the watermark are dropped, as the caller sets it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def change_events(stream: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(key, order..., from_state, to_state) events where a key's state differs from its last one, with the state kept across batches.

    Rows of a batch are taken in order; the state of a key is its last value, which is all that is kept.
    """
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    fields = ", ".join(f"{c} {kinds[c]}" for c in order)

    def step(k, frames, held):
        last = held.get[0] if held.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for values in rows[[*order, state]].itertuples(index=False):
            if last is not None and values[-1] != last:
                out.append((k[0], *values[:-1], last, values[-1]))
            last = values[-1]
        held.update((last,))
        yield pd.DataFrame(out, columns=[key, *order, "from_state", "to_state"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {fields}, from_state string, to_state string", "last string", "append", "NoTimeout")


def run_to_folder(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
