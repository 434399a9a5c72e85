"""Joins for keys that may hold a large part of all rows."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.inputs import free_name
from strandline.operators.components import cut_lineage

#: A key is hot if more than one in so many rows has it; there are fewer such keys than this, whatever the table.
HOT_KEYS = 4096
#: Bits of a filter a key, and bits of a filter at most (256 MB); a fuller filter lets more rows through to the join behind it.
KEY_BITS, MOST_BITS = 16, 1 << 31
#: Bits of a bitmap of Spark's bitmap functions.
_MAP = 32_768


def beside(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a broadcast of few, by keys that are longs without nulls.

    The hash table is by the first key alone, which Spark keeps small; further keys are compared where
    that one fits (as exclusive or, as equality would become a key of the table).
    """
    other = {k: free_name(rows, f"_{k}_of_few") for k in keys}
    few = F.broadcast(few.withColumnsRenamed(other))
    same = rows[keys[0]] == few[other[keys[0]]]
    for k in keys[1:]:
        same &= rows[k].bitwiseXOR(few[other[k]]) == 0
    return rows.join(few, same, how).drop(*other.values())


def join_counted(rows: DataFrame, known: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with known, which has one row a key with the number (weight) of the rows that have it; how: inner or left.

    Rows of hot keys meet a broadcast of those keys, at most HOT_KEYS rows, where they are; the others
    are shuffled by key, and none of their keys has more than one in HOT_KEYS rows. Keys are longs.
    """
    known = cut_lineage(known)
    total = known.agg(F.sum(weight)).first()[0]
    if not total:
        return rows.join(known, keys, how)
    is_hot = F.col(weight) * HOT_KEYS > total
    hot, cold = known.where(is_hot), known.where(~is_hot)
    rest = beside(rows, hot.select(*keys), keys, "left_anti")
    return beside(rows, hot, keys).unionByName(rest.join(cold, keys, how))


def _spot(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def maybe_among(rows: DataFrame, known: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """rows with a boolean column flag: false only where known has no row of these keys.

    A Bloom filter of known's keys, made and tested by Spark's bitmap functions, goes to every task: one
    bitmap of 4 KB for each 2048 keys, 65,536 of them at most. With KEY_BITS bits a key one other row in
    16 passes; beyond 134 million keys more do. Whatever the sizes, the plan is the same.
    """
    bits = min(MOST_BITS, -(-max(1, known.count() * KEY_BITS) // _MAP) * _MAP)
    part, place, held = (free_name(rows, n) for n in ("_part", "_place", "_held"))
    spot = _spot(keys, bits)
    maps = known.select(F.floor(spot / _MAP).alias(part), (spot % _MAP).alias(place)).groupBy(part).agg(F.bitmap_construct_agg(place).alias(held))
    at = spot % _MAP
    byte = F.conv(F.hex(F.substring(held, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # the bit of the byte, the lowest first
    bit = F.floor(byte / F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8).cast("int") + 1)) % 2 == 1
    return rows.withColumn(part, F.floor(spot / _MAP)).join(F.broadcast(maps), part, "left").withColumn(flag, F.coalesce(bit, F.lit(False))).drop(part, held)


def let_go(spark: SparkSession) -> None:
    """Have shuffle files and checkpoints removed that no frame refers to any more.

    Spark removes them when the driver collects its garbage, which with a large heap may be long after;
    until then they lie on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def only_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows among which are all whose key is among ids, and few others; the exact join follows."""
    flag = free_name(rows, "_maybe")
    return maybe_among(rows, ids, [key], flag).where(flag).drop(flag)


def split_rows(rows: DataFrame, found: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows joined with found, the rows whose keys found has not); found has one row a key, keys are longs without nulls.

    Only rows that pass a filter of found's keys are shuffled.
    """
    flag, hit = free_name(rows, "_maybe"), free_name(rows, "_hit")
    flagged = maybe_among(rows, found, keys, flag)
    joined = flagged.where(flag).drop(flag).join(found.withColumn(hit, F.lit(True)).hint("merge"), keys, "left")
    touched = joined.where(F.col(hit).isNotNull()).drop(hit)
    return touched, flagged.where(~F.col(flag)).drop(flag).unionByName(joined.where(F.col(hit).isNull()).select(rows.columns))
