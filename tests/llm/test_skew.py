import pytest
from pyspark.sql import functions as F

from strandline.llm import skew


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_a_filter_misses_no_key(spark, n):
    rows = spark.range(20_000).select((F.col("id") * 7919).alias("id"), F.lit("x").alias("_part"), F.lit(1).alias("_maybe"))
    known = spark.range(n).select((F.col("id") * 4 * 7919).alias("id"))
    found = skew.maybe_among(rows, known, ["id"], "flag").select("id", "flag").collect()
    assert len(found) == 20_000
    hits = {r.id for r in found if r.flag}
    want = {4 * 7919 * i for i in range(n)}
    assert want <= hits and len(hits - want) <= (20_000 - n) / 8 * bool(n)
    few = {r.id for r in skew.only_ids(rows, known, "id").collect()}
    assert few == hits


@pytest.mark.parametrize("bits", [skew.MOST_BITS, 32_768])
def test_split_is_exact_whatever_passes(spark, monkeypatch, bits):
    monkeypatch.setattr(skew, "MOST_BITS", bits)  # a filter too small for its keys lets nearly all rows through
    rows = spark.range(3000).select((F.col("id") % 1000).alias("a"), F.lit(5).cast("long").alias("b"), F.concat(F.lit("t"), "id").alias("text"))
    found = spark.range(60_000).where("id % 3 = 0").select(F.col("id").alias("a"), F.lit(5).cast("long").alias("b"), F.lit("v").alias("new"))
    touched, rest = skew.split_rows(rows, found, ["a", "b"])
    assert sorted(r.text for r in touched.collect()) == sorted(f"t{i}" for i in range(3000) if i % 1000 % 3 == 0)
    assert sorted(r.text for r in rest.collect()) == sorted(f"t{i}" for i in range(3000) if i % 1000 % 3) and rest.columns == ["a", "b", "text"]
    nothing = skew.split_rows(rows, found.limit(0), ["a", "b"])
    assert nothing[0].count() == 0 and nothing[1].count() == 3000
