"""Nested values and wide overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.components import cut_lineage


def flatten_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of every leaf of a JSON text: paths like ``a.b[2].c``, value as text (null for a JSON null).

    Any depth and any keys. Text that isn't JSON, and null, gives no rows; empty objects and lists give
    none; a bare value has an empty path; a repeated key of an object is malformed JSON and gives none.
    Each level is one pass over the values that are still nested, so work follows the size of the texts.
    """
    level = rows.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null")
    leaves = []
    while True:
        level = cut_lineage(level.withColumn("nested", F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")))
        leaves.append(level.where("not nested").select("key", "path", F.try_variant_get("v", "$", "string").alias("value")))
        level = level.where("nested")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, leaves).withColumnRenamed("key", key)
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inner"))
        named = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))).when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name"))
        level = inner.select("key", named.alias("path"), F.col("inner").alias("v"))


def overview(base: DataFrame, key: str, kinds: dict[str, tuple], most: int = 20) -> DataFrame:
    """base with ``facts``: map from each kind to struct(n, list), its number of rows and its first ``most`` distinct labels, sorted.

    kinds maps a name to (rows with the key, label or None) or (rows, label, condition); a label is a column or its name,
    a condition a column. Kinds of one table should be given the same DataFrame: its rows are dealt by key once, with only the
    columns that are needed, and counted where they arrive for all of its kinds, in place of a scan, a row and a join for
    each kind: optional facts never multiply. Every kind is in every map, with 0 and no labels where a key has no rows;
    null labels count but aren't listed; rows of a null or unknown key are left out. A key's labels of a kind meet in one
    task, so labels should be categories, not identifiers.
    """
    tables: dict[int, tuple[DataFrame, list[tuple[int, Column, Column | None]]]] = {}
    for i, (df, label, *condition) in enumerate(kinds.values()):
        hit = F.coalesce(condition[0], F.lit(False)) if condition else F.lit(True)
        tables.setdefault(id(df), (df, []))[1].append((i, hit, None if label is None else (F.col(label) if isinstance(label, str) else label).cast("string")))
    parts = []
    for df, own in tables.values():
        # dealt as it is: what kinds ask of a row is worked out where it arrives
        dealt = df.where(F.col(key).isNotNull()).repartition(key).select(F.col(key).alias(key), *[hit.alias(f"_h{i}") for i, hit, _ in own], *[F.when(hit, label).alias(f"_l{i}") for i, hit, label in own if label is not None])
        parts.append(dealt.groupBy(key).agg(*[F.count_if(F.col(f"_h{i}")).alias(f"_n{i}") for i, _, _ in own], *[(F.collect_set(f"_l{i}") if label is not None else F.array().cast("array<string>")).alias(f"_l{i}") for i, _, label in own]))
    found = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
    entry = lambda i: F.struct(F.coalesce(F.col(f"_n{i}"), F.lit(0)).alias("n"), F.slice(F.array_sort(F.coalesce(f"_l{i}", F.array().cast("array<string>"))), 1, most).alias("list"))
    return base.join(found, key, "left").select(*base.columns, F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), entry(i))]).alias("facts"))
