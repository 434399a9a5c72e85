"""Connected components of an edge table by alternating large-star / small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder ``spark.checkpoint.dir``; only where that is unset, and only in local mode (tests), one beside the warehouse.

    On a cluster without that setting there is no folder that is known to be shared, so this raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; edges (a, b) with a > b, returned in the same orientation and without repeats."""
    near = edges.select("a", "b")
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = near.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select("a", F.least("a", "m").alias("m"))
    joined = near.join(low, "a")
    if large:
        # neighbours above the centre are hung on the smallest neighbour
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component): every endpoint of an edge with the smallest id it can reach.

    Edges are undirected; nulls and self loops add nothing, repeats are harmless, an empty table gives
    an empty result. Work a round: two shuffles of the remaining edges; rounds grow with log of the
    longest path. Raises if ``max_rounds`` did not suffice, rather than returning open labels.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"), (F.col(src).isNull() | F.col(dst).isNull()).alias("n"))
    cur = cut_lineage(e.where("not n and a <> b").select("a", "b").distinct())
    mark = None
    for _ in range(max_rounds):
        cur = cut_lineage(_star(_star(cur, True), False))
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components still open after {max_rounds} rounds")
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
