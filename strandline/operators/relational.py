"""Joins, aggregates, windows and set operations over longitudinal facts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.components import connected_components, cut_lineage

#: Rows of a bucket that one part holds, and rows that meet in one partition, where pairs of a band are made.
PART_ROWS, TASK_MEETINGS = 4096, 2**26


def fact_edges(facts: DataFrame, dimension: DataFrame, key: str, src: str, dst: str, kind: str, *props: str) -> DataFrame:
    """(src, type, dst, props...) of facts whose key the dimension has."""
    return facts.join(dimension.select(key).distinct(), key, "left_semi").select(F.col(src).alias("src"), F.lit(kind).alias("type"), F.col(dst).alias("dst"), *props)


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right lacks."""
    return left.join(right.select(key), key, "left_anti")


def optional_counts(base: DataFrame, key: str, facts: dict[str, DataFrame]) -> DataFrame:
    """base with n_<name> for each fact table, 0 without rows. Each is counted by key before it is joined, so nothing fans out."""
    for name, rows in facts.items():
        base = base.join(rows.groupBy(key).agg(F.count("*").alias(f"n_{name}")), key, "left")
    return base.fillna(0, [f"n_{n}" for n in facts])


def later_pairs(rows: DataFrame, key: str, time: str, *columns: str, strict: bool = True) -> DataFrame:
    """Pairs of rows of one key with time_1 < time_2, columns suffixed _1 and _2."""
    one, two = (rows.select(F.col(key), *[F.col(c).alias(f"{c}_{i}") for c in (time, *columns)]) for i in (1, 2))
    before = F.col(f"{time}_1") < F.col(f"{time}_2") if strict else F.col(f"{time}_1") <= F.col(f"{time}_2")
    return one.join(two, key).where(before)


def min_gap(rows: DataFrame, key: str, time: str, state: str, first: str, then: str) -> DataFrame:
    """(key, gap): least time from a row in state first to a later one in state then; one pass over a window instead of a self join."""
    earlier = Window.partitionBy(key).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col(state) == first, F.col(time))).over(earlier)
    return rows.select(key, F.when(F.col(state) == then, F.col(time) - last).alias("gap")).groupBy(key).agg(F.min("gap").alias("gap")).where("gap is not null")


def nearest_partner(cases: DataFrame, controls: DataFrame, key: str, value: str, case_id: str, control_id: str, width: int) -> DataFrame:
    """For each case the control of equal key nearest in value, at most width away; ties to the smaller control id.

    Of the controls of one key and value only the two least ids can be nearest (two, as a case is not its own control), so
    the others go before the join. Values are put in buckets of that width and a case meets three of them: an equi join.
    """
    least = pick(controls.select(key, F.col(control_id).alias("control_id"), F.col(value).alias("control_value")).distinct(), [key, "control_value"], [F.col("control_id")], 2)
    left = cases.select(key, F.col(case_id).alias("case_id"), F.col(value).alias("case_value"), F.explode(F.array(*[F.floor(F.col(value) / width) + i for i in (-1, 0, 1)])).alias("_bucket"))
    right = least.drop("rank").withColumn("_bucket", F.floor(F.col("control_value") / width))
    gap = F.abs(F.col("case_value") - F.col("control_value"))
    pairs = left.join(right, [key, "_bucket"]).where((gap <= width) & (F.col("case_id") != F.col("control_id")))
    best = pairs.groupBy("case_id").agg(F.min(F.struct(gap.alias("gap"), "control_id")).alias("b"))
    return best.select("case_id", "b.control_id", F.col("b.gap").alias("gap"))


def similarity_band(rows: DataFrame, key: str, value: str, row_id: str, width: float) -> DataFrame:
    """(a, b) with a < b, equal key and values at most width apart as doubles: each such pair of rows, once.

    Values are put in buckets of a quarter of the width (a little wider, as differences round) and a row meets the rows of
    its own and of the four above it, so most rows that meet are pairs. A bucket is dealt in parts of some PART_ROWS
    rows, the most that a task holds at once, over partitions in proportion to the rows that meet: a task's share grows
    neither with the square of the table nor with that of a value's copies. Rows without key or finite value have no pair.
    """
    v = F.col(value).cast("double")
    place = F.floor(F.least(F.greatest(v / (width * (1 + 2**-10) / 4), F.lit(-(2.0**62))), F.lit(2.0**62)))
    placed = rows.where(F.col(key).isNotNull() & (F.abs(v) < float("inf"))).select(key, F.col(row_id).alias("_id"), v.alias("_v"), place.alias("_bucket"))
    counted = placed.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    meet = counted.agg(F.sum(5.0 * F.col("_n") * F.col("_n"))).first()[0] or 0.0
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(meet / TASK_MEETINGS), 65_536))
    parts = counted.select(key, "_bucket", F.ceil(F.col("_n") / PART_ROWS).alias("_parts"))
    up = F.explode(F.array(*[F.struct((F.col("_bucket") + i).alias("_bucket"), F.lit(i).alias("_up")) for i in range(5)])).alias("_to")
    left = placed.select(key, F.col("_id").alias("_x"), F.col("_v").alias("_w"), up).select(key, "_x", "_w", "_to.*").join(parts, [key, "_bucket"])
    left = left.select(key, "_bucket", "_up", "_x", "_w", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    right = placed.join(parts, [key, "_bucket"]).select(key, "_bucket", F.col("_id").alias("_y"), "_v", F.pmod(F.xxhash64("_id"), "_parts").alias("_part"))
    dealt = [side.repartition(partitions, key, "_bucket", "_part") for side in (left, right)]
    once = F.when(F.col("_up") == 0, F.col("_x") < F.col("_y")).otherwise(F.col("_x") != F.col("_y"))
    pairs = dealt[0].join(dealt[1].hint("merge"), [key, "_bucket", "_part"]).where(once & (F.abs(F.col("_w") - F.col("_v")) <= width))
    return pairs.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def band_counts(rows: DataFrame, key: str, value: str, row_id: str, width: float, difference: bool = False) -> DataFrame:
    """(row_id, key, near): how many other rows of equal key have a value at most width apart; no pair is made.

    The bounds are value - width and value + width as doubles or, with difference, a value v is near if abs(value - v) <=
    width as doubles, which is the same for both of a pair.
    Rows without key or finite value are left out; equal values count each other. Values are counted once each and
    sent to their bucket, a little wider than the width, and as neighbours to the two beside it. There one sort places
    them among the bounds and running counts are read off at the bounds, so work doesn't grow with the neighbours.
    A difference rounds to at most width if it is at most width and half a unit in its last place (less than that, if
    width is odd in that place); such bounds are kept exact as sums of two doubles.
    """
    width = float(width)
    half, even = math.ulp(width) / 2, (width / math.ulp(width)) % 2 == 0
    finite = rows.where(F.col(key).isNotNull() & (F.abs(F.col(value).cast("double")) < float("inf"))).select(row_id, key, (F.col(value).cast("double") + 0.0).alias("_v"))

    def plus(x: Column, y: Column | float) -> tuple[Column, Column]:
        y = F.lit(y) if isinstance(y, float) else y
        total = x + y
        turned = total - x
        return total, (x - (total - turned)) + (y - turned)

    def bound(side: int) -> Column:
        high, low = plus(F.col("_v"), side * width)
        high, low = plus(high, low + side * half) if difference else (high, F.lit(0.0))
        return F.struct(F.col("_b"), (high + 0.0).alias("high"), (low + 0.0).alias("low"), F.lit(side if even or not difference else -side).alias("turn"), F.lit(side).alias("side"))

    point = lambda i: F.struct((F.col("_b") + i).alias("_b"), F.col("_v").alias("high"), F.lit(0.0).alias("low"), F.lit(0).alias("turn"), F.lit(0).alias("side"))
    counted = finite.groupBy(key, "_v").agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col("_v") / (width * (1 + 2**-10))))
    each = counted.select(key, "_v", "_n", F.explode(F.array(point(-1), point(0), point(1), bound(-1), bound(1))).alias("_e")).select(key, "_v", "_n", "_e.*")
    upto = F.sum(F.when(F.col("side") == 0, F.col("_n")).otherwise(0)).over(Window.partitionBy(key, "_b").orderBy("high", "low", "turn").rowsBetween(Window.unboundedPreceding, 0))
    near = each.withColumn("_upto", upto).where("side <> 0").groupBy(key, "_v").agg((F.sum(F.col("side") * F.col("_upto")) - 1).alias("near"))
    return finite.join(near, [key, "_v"]).select(row_id, key, "near")


def similarity_classes(rows: DataFrame, key: str, value: str, row_id: str, width: float) -> DataFrame:
    """(row_id, class_id, links) of every row: its links to rows of equal key and values at most width apart, and the least id that links lead to.

    The links are those of ``similarity_band``, counted by ``band_counts``; ids are distinct. Rows of half a width's bucket
    are linked all, so only buckets, by their least and greatest values, are joined and their components found. Rows
    without key or finite value have no links and are their own class.
    """
    links = band_counts(rows, key, value, row_id, width, difference=True).select(row_id, F.col("near").alias("_links"))
    v = F.col(value).cast("double")
    placed = rows.select(row_id, key, v.alias("_v"), F.when(F.abs(v) < float("inf"), F.floor(v / (width / 2))).alias("_b"))
    spans = cut_lineage(placed.where(F.col(key).isNotNull() & F.col("_b").isNotNull()).groupBy(key, "_b").agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.min(row_id).alias("first")))
    ahead = spans.select(key, F.col("high").alias("_high"), F.col("first").alias("_first"), F.explode(F.array(*[F.col("_b") + i for i in (1, 2, 3)])).alias("_b"))
    edges = spans.join(ahead, [key, "_b"]).where(F.col("low") - F.col("_high") <= width).select(F.col("_first").alias("src"), F.col("first").alias("dst"))
    classes = spans.join(connected_components(edges).withColumnRenamed("id", "first"), "first", "left").select(key, "_b", F.coalesce("component", "first").alias("_class"))
    return placed.join(classes, [key, "_b"], "left").join(links, row_id, "left").select(row_id, F.coalesce("_class", row_id).alias("class_id"), F.coalesce("_links", F.lit(0)).alias("links"))


def before_after(before: DataFrame, after: DataFrame, name: str, value: str) -> DataFrame:
    """(name, before, after, delta): full outer, a missing side counts 0."""
    rows = before.select(name, F.col(value).alias("before")).join(after.select(name, F.col(value).alias("after")), name, "full_outer").fillna(0, ["before", "after"])
    return rows.withColumn("delta", F.col("after") - F.col("before"))


def summary(rows: DataFrame, value: str, *by: str, places: int = 6) -> DataFrame:
    """count, mean, least, greatest and sample deviation by group."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), places).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.stddev_samp(value), places).alias("sd"))


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(by, <name>...): exact quantiles of each group, interpolated between neighbouring ranks; null values are left out.

    An approximate pass brackets each quantile within two of its own errors (n / accuracy ranks); values are counted by
    value, those outside a bracket only add to its counts, and just the distinct values inside are sorted. So no task
    holds a group's values: a bracket has at most 4 / accuracy of the group's rows beside ties, which are one row.
    """
    base = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v"))
    ends = [q for p in shares.values() for q in (max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy))]
    stats = base.groupBy("_by").agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_q"))
    each = [F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at"), F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi")) for i, (name, p) in enumerate(shares.items())]
    brackets = stats.select(F.col("_by").alias("_group"), F.explode(F.array(*each)).alias("b")).select("_group", "b.*")
    values = base.groupBy("_by", "_v").agg(F.count("*").alias("_n")).join(brackets, F.col("_by").eqNullSafe(F.col("_group"))).drop("_group")
    around = values.groupBy("_by", "name", "at").agg(F.sum(F.when(F.col("_v") < F.col("lo"), F.col("_n")).otherwise(0)).alias("below"), F.max(F.when(F.col("_v") < F.col("lo"), F.col("_v"))).alias("previous"), F.min(F.when(F.col("_v") > F.col("hi"), F.col("_v"))).alias("following"))
    upto = F.sum("_n").over(Window.partitionBy("_by", "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    inside = values.where("_v between lo and hi").select("_by", F.col("name").alias("_name"), "_v", "_n", upto.alias("upto"))
    placed = inside.withColumnRenamed("_by", "_group").join(around, F.col("_by").eqNullSafe(F.col("_group")) & (F.col("name") == F.col("_name")))
    holds = lambda rank: F.max(F.when((rank - F.col("below") < F.col("upto")) & (rank - F.col("below") >= F.col("upto") - F.col("_n")), F.col("_v")))
    both = placed.groupBy("_by", "name", "at", "previous", "following").agg(holds(F.floor("at")).alias("low"), holds(F.ceil("at")).alias("high"))
    low, high = F.coalesce("low", "previous"), F.coalesce("high", "following")
    done = both.select("_by", "name", (low + (high - low) * (F.col("at") - F.floor("at"))).alias("v"))
    return done.groupBy(F.col("_by").alias(by)).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in shares])


def share_of_total(counted: DataFrame, n: str = "n", *within: str) -> DataFrame:
    """counted with pct, n as a percentage of all rows' (of the group's, with within)."""
    over = Window.partitionBy(*within)
    return counted.withColumn("pct", F.round(100 * F.col(n) / F.sum(n).over(over), 4))


def missing_share(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(property, missing, share) by one aggregate over all columns."""
    one = rows.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).alias("missing")) for c in columns])).alias("s")).select("s.property", "s.missing", F.round(F.col("s.missing") / F.col("_n"), 6).alias("share"))


def pivot_first(rows: DataFrame, key: str, column: str, values: list[str], value: str, order: list[str]) -> DataFrame:
    """One column for each of values: the key's first value in that order."""
    return rows.groupBy(key).agg(*[F.min_by(F.when(F.col(column) == v, F.col(value)), F.when(F.col(column) == v, F.struct(*order))).alias(v) for v in values])


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, by one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs])).alias("s")).select("s.*")


def next_distinct(rows: DataFrame, key: str, time: str) -> DataFrame:
    """(key, time, next_time, gap) of each distinct time and the nearest later one; ties at one time are one."""
    w = Window.partitionBy(key).orderBy(time)
    times = rows.select(key, time).distinct().withColumn("next_time", F.lead(time).over(w))
    return times.where("next_time is not null").withColumn("gap", F.col("next_time") - F.col(time))


def changes(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before, with from_value and prior_<first order column>."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("from_value", F.lag(value).over(w)).withColumn(f"prior_{order[0]}", F.lag(order[0]).over(w))
    return out.where(F.col("from_value").isNotNull() & (F.col("from_value") != F.col(value)))


def first_last(rows: DataFrame, by: list[str], order: list[str], value: str, time: str, least: int = 2) -> DataFrame:
    """First and last value with n, duration and change a month of keys with at least that many points."""
    at = F.struct(*order)
    out = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), (F.max(time) - F.min(time)).alias("duration"))
    return out.where(f"n >= {least}").withColumn("rate", F.when(F.col("duration") > 0, F.round((F.col("last_value") - F.col("first_value")) / F.col("duration"), 6)))


def pick(rows: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in that order, with rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def delta_to_last_known(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with delta to the last non-null value before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("delta", F.col(value) - F.last(value, ignorenulls=True).over(w))


def first_keys(rows: DataFrame, by: str, order: list[str], value: str, k: int = 3) -> DataFrame:
    """(by, key): the first k distinct values by their first appearance, joined with >."""
    firsts = rows.groupBy(by, value).agg(F.min(F.struct(*order)).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", value)))
    return firsts.groupBy(by).agg(F.array_join(F.slice(F.transform(listed, lambda s: s[value]), 1, k), ">").alias("key"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def union_schemas(*frames: DataFrame) -> DataFrame:
    """Distinct rows of frames with different columns, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).distinct()


def set_difference(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): TP, FP or FN."""
    a, b = found.select(*keys).distinct().withColumn("_f", F.lit(True)), truth.select(*keys).distinct().withColumn("_t", F.lit(True))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("_f") & F.col("_t"), "TP").when(F.col("_f"), "FP").otherwise("FN").alias("status"))
