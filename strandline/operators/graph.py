"""Property-graph operators over node (id, label, uri) and edge (src, type, dst, uri) tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.components import connected_components, cut_lineage


def ends(edges: DataFrame, *columns: str) -> DataFrame:
    """(id, other, columns..., direction): each edge from both of its ends, by one scan of the edges."""
    out, back = (F.struct(F.col(x).alias("id"), F.col(y).alias("other"), F.lit(way).alias("direction")) for x, y, way in (("src", "dst", "out"), ("dst", "src", "in")))
    return edges.select(*columns, F.explode(F.array(out, back)).alias("_e")).select("_e.id", "_e.other", *columns, "_e.direction")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree), undirected; counted before the shuffle, so a hub costs one row a task."""
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, types: list[str], k: int) -> DataFrame:
    """The k ids with most edges in."""
    return edges.where(F.col("type").isin(types)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "id").limit(k)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges).select("id"), "id", "left_anti")


def component_sizes(edges: DataFrame, k: int) -> DataFrame:
    return connected_components(edges).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(k)


def paths(edges: DataFrame, longest: int, start: DataFrame | None = None, simple: bool = True, weight: str | None = None) -> DataFrame:
    """(first, last, length, path[, cost]) of directed paths of 1..longest edges, from the ids of start if given; simple: no node twice.

    One join a level on the path's last node. The number of paths can grow with each level, as it does in the result.
    """
    cost = F.col(weight).cast("double") if weight else F.lit(0.0)
    hop = edges.select(F.col("src").alias("last"), F.col("dst").alias("next"), cost.alias("w"))
    level = hop if start is None else hop.join(start.select(F.col("id").alias("last")).distinct(), "last", "left_semi")
    if simple:
        level = level.where("last <> next")
    level = level.select(F.col("last").alias("first"), F.col("next").alias("last"), F.lit(1).alias("length"), F.array("last", "next").alias("path"), F.col("w").alias("cost"))
    out = level
    for n in range(2, longest + 1):
        level = level.join(hop, "last")
        if simple:
            level = level.where(~F.array_contains("path", F.col("next")))
        level = level.select("first", F.col("next").alias("last"), F.lit(n).alias("length"), F.concat("path", F.array("next")).alias("path"), (F.col("cost") + F.col("w")).alias("cost"))
        out = out.unionByName(level)
    return out if weight else out.drop("cost")


def shortest_paths(edges: DataFrame, source: str, most: int = 6) -> DataFrame:
    """(id, hops): least hops from source to each id within that many, undirected; each level meets only new ids."""
    spark = edges.sparkSession
    hop = ends(edges).select("id", "other")
    seen = frontier = spark.createDataFrame([(source, 0)], "id string, hops int")
    for n in range(1, most + 1):
        # the frontier is the small side: edges, scanned once a level, stay where they are if it can be broadcast
        new = frontier.select("id").join(hop, "id").select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = cut_lineage(new.withColumn("hops", F.lit(n)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(edges: DataFrame, source: str, hops: int) -> DataFrame:
    """Edges between ids within that many hops of source."""
    near = cut_lineage(shortest_paths(edges, source, hops).select("id"))
    return edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi")


def closure(edges: DataFrame, kind: str, deepest: int) -> DataFrame:
    """(descendant, ancestor, depth) over edges of one type, least depth of each pair."""
    return paths(edges.where(F.col("type") == kind), deepest, simple=False).groupBy(F.col("first").alias("descendant"), F.col("last").alias("ancestor")).agg(F.min("length").alias("depth"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("e"))
    return n.crossJoin(e).select("n", "e", F.round(F.expr("e / (n * (n - 1))"), 9).alias("density"), F.round(F.expr("2 * e / n"), 6).alias("avg_degree"))


def patterns(nodes: DataFrame, edges: DataFrame, over: int) -> DataFrame:
    """(src_label, type, dst_label, n) of more than that many edges."""
    label = lambda e: nodes.select(F.col("id").alias(e), F.col("label").alias(f"{e}_label"))
    return edges.join(label("src"), "src").join(label("dst"), "dst").groupBy("src_label", "type", "dst_label").agg(F.count("*").alias("n")).where(F.col("n") > over)


def parallel_edges(edges: DataFrame) -> DataFrame:
    """(type, extra): edges beyond the first of each (src, type, dst)."""
    once = edges.groupBy("src", "type", "dst").agg(F.count("*").alias("n"))
    return once.groupBy("type").agg(F.sum(F.col("n") - 1).alias("extra"))


def dense_ids(nodes: DataFrame, column: str) -> tuple[DataFrame, int]:
    """((column, number), count): the column's distinct non-null values numbered from 0 without gaps.

    Each partition is counted and numbered by itself; the driver holds one count a partition.
    """
    each = cut_lineage(nodes.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_part", F.spark_partition_id()))
    before, total = [], 0
    for r in each.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        before.append((r["_part"], total))
        total += r.n
    skip = F.broadcast(each.sparkSession.createDataFrame(before, "_part int, _skip long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return each.withColumn("_at", place).join(skip, "_part").select(column, (F.col("_skip") + F.col("_at")).alias("number")), total


#: Neighbours from which on a node's neighbours are kept as bitmaps: 4096 bytes hold as much as 512 numbers.
HUB = 512


def reach(edges: DataFrame, seeds: DataFrame, hub: int = HUB) -> DataFrame:
    """(id, reach): distinct nodes within two hops of each seed, undirected, itself left out; seeds without neighbours have no row.

    Only the edges at seeds and at their neighbours are kept; the ids these reach are numbered without gaps. A hub's
    neighbours are bitmaps, made once, that its neighbours take over as they are; of other nodes each neighbour is a
    row. So a hub of d neighbours gives d times (nodes / 32,768) rows at most instead of d squared, and the count of
    distinct nodes is exact. Seeds of equal neighbours (by their number and two sums of 64-bit hashes) reach the same
    nodes, so one of them is followed for all.
    """
    every_hop = ends(edges).select("id", "other").where("id is not null and other is not null and id <> other")
    first = cut_lineage(every_hop.join(seeds.select("id").distinct(), "id", "left_semi").distinct())
    second = every_hop.join(first.select(F.col("other").alias("id")).distinct(), "id", "left_semi")
    hop = cut_lineage(first.unionByName(second).distinct())
    numbers, _ = dense_ids(hop.select(F.col("other").alias("id")), "id")
    hop = cut_lineage(hop.join(numbers.select(F.col("id").alias("other"), F.col("number").alias("far")), "other"))
    bit = (F.bitmap_bucket_number("far").alias("bucket"), F.bitmap_bit_position("far").alias("bit"))
    large = hop.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= hub).select("id")
    maps = hop.join(large, "id", "left_semi").select("id", *bit).groupBy("id", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    total = lambda *salt: F.sum(F.xxhash64("far", *salt).cast("decimal(38,0)"))
    near = hop.join(seeds.select("id").distinct(), "id", "left_semi")
    sets = near.groupBy("id").agg(F.struct(F.count("*").alias("n"), total().alias("x"), total(F.lit(1)).alias("y")).alias("near"))
    alike = cut_lineage(sets.join(sets.groupBy("near").agg(F.min("id").alias("for")), "near").select("id", "for"))
    one = near.join(alike.where("id = for").select("id"), "id", "left_semi")
    # the second hop by rows, and the first, which every seed has by rows
    rest = hop.join(large, "id", "left_anti").select(F.col("id").alias("other"), "far")
    by_row = one.select("id", "far").unionByName(one.select("id", "other").join(rest, "other").select("id", "far"))
    few = by_row.select("id", *bit).groupBy("id", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    many = one.select("id", "other").join(maps.withColumnRenamed("id", "other"), "other").select("id", "bucket", "map")
    every = few.unionByName(many).groupBy("id", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("map")).alias("n")).groupBy("id").agg(F.sum("n").alias("n"))
    # a seed with a neighbour comes back to itself on the second hop
    return alike.join(every.select(F.col("id").alias("for"), "n"), "for").select("id", (F.col("n") - 1).alias("reach"))


def reach_histogram(reached: DataFrame) -> DataFrame:
    """(bucket, seeds): seeds by reach, exact below 100 and by hundreds from there."""
    bucket = F.when(F.col("reach") < 100, F.col("reach")).otherwise(F.col("reach") - F.col("reach") % 100)
    return reached.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("seeds"))


def chain(edges: DataFrame, *types: str) -> DataFrame:
    """(n0, n1, ...) along edges of these types in order."""
    out = None
    for k, kind in enumerate(types):
        hop = edges.where(F.col("type") == kind).select(F.col("src").alias(f"n{k}"), F.col("dst").alias(f"n{k + 1}"))
        out = hop if out is None else out.join(hop, f"n{k}")
    return out


def ego(edges: DataFrame, nodes: DataFrame, source: str) -> DataFrame:
    """Edges of one node with direction and the other end's display name."""
    near = ends(edges.where((F.col("src") == source) | (F.col("dst") == source)), "type").where(F.col("id") == source)
    names = nodes.select(F.col("id").alias("other"), "label", F.coalesce("name", "id").alias("display"))
    return near.join(names, "other", "left").select("id", "direction", "type", "other", "label", "display")


def typed_edges(members: DataFrame, types: dict[str, tuple[str, str]]) -> DataFrame:
    """Both directions of (a, relation, b) rows: types maps a relation to its edge type and the inverse's."""
    rule = members.sparkSession.createDataFrame([(k, *v) for k, v in types.items()], "relation string, forth string, back string")
    rows = members.join(F.broadcast(rule), "relation")
    return rows.select(F.col("a").alias("src"), F.col("forth").alias("type"), F.col("b").alias("dst")).unionByName(rows.select(F.col("b").alias("src"), F.col("back").alias("type"), F.col("a").alias("dst")))


def missing_inverses(edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Edges that the inverse map calls for and that aren't there."""
    rule = edges.sparkSession.createDataFrame(list(inverse.items()), "type string, inverse string")
    want = edges.join(F.broadcast(rule), "type").select(F.col("dst").alias("src"), F.col("inverse").alias("type"), F.col("src").alias("dst")).distinct()
    return want.join(edges.select("src", "type", "dst"), ["src", "type", "dst"], "left_anti")


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without edges out, or without edges in, are peeled off until none goes; a chain takes a round for two of its edges."""
    left = cut_lineage(edges)
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = cut_lineage(inner.select("src", "dst"))
        now = left.count()
        if now == n:
            break
        n = now
    return left


def _least_ancestors(edges: DataFrame) -> DataFrame:
    """(id, mark): the least id from which edges lead to the id, or itself; a round for each edge of the way."""
    marks = cut_lineage(ends(edges).select("id").distinct().withColumn("mark", F.col("id")))
    moved = marks
    while not moved.isEmpty():
        sent = edges.join(moved.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("mark").alias("new"))
        moved = cut_lineage(sent.join(marks, "id").where("new < mark").select("id", "new"))
        marks = cut_lineage(marks.join(moved, "id", "left").select("id", F.least("mark", "new").alias("mark")))
        moved = moved.withColumnRenamed("new", "mark")
    return marks


def on_cycles(edges: DataFrame) -> DataFrame:
    """(src, dst): distinct edges that lie on a directed cycle, self loops among them.

    Edges whose ends have one least ancestor and lead back to it are in one strongly connected part, so on a cycle;
    the parts found go and the rest, peeled again, is searched until nothing is left. Empty edges give no rows.
    """
    found = []
    left = _peeled(edges.select("src", "dst").distinct())
    while not left.isEmpty():
        mark = _least_ancestors(left)
        marked = left.join(mark.withColumnRenamed("id", "src"), "src").join(mark.select(F.col("id").alias("dst"), F.col("mark").alias("_other")), "dst")
        inside = cut_lineage(marked.where("mark = _other").select("src", "dst", "mark"))
        back = frontier = cut_lineage(inside.select(F.col("mark").alias("id")).distinct())
        while not frontier.isEmpty():
            new = inside.join(frontier.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
            frontier = cut_lineage(new.join(back, "id", "left_anti"))
            back = back.unionByName(frontier)
        back = cut_lineage(back)
        either = lambda how: inside.join(back.withColumnRenamed("id", "src"), "src", how).join(back.withColumnRenamed("id", "dst"), "dst", how).select("src", "dst")  # noqa: B023, E731
        found.append(cut_lineage(either("left_semi")))
        left = _peeled(either("left_anti"))
    return reduce(DataFrame.unionByName, found) if found else left


def circular_paths(edges: DataFrame, longest: int = 4) -> DataFrame:
    """(path, length) of directed cycles of 2..longest edges without a repeated node, each once, from its least id; only greater ids follow, which halves the paths a level and more."""
    hop = cut_lineage(edges.where("src <> dst").select("src", "dst").distinct())
    step = hop.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    level = hop.where("src < dst").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    out = []
    for n in range(2, longest + 1):
        grown = level.join(step, "last")
        out.append(grown.where("next = first").select("path", F.lit(n).alias("length")))
        level = grown.where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next"))).select("first", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"))
    return reduce(DataFrame.unionByName, out)


def edge_errors(edges: DataFrame, *shares: str) -> DataFrame:
    """(src, type, dst, error): self loops and values outside 0..1."""
    error = F.when(F.col("src") == F.col("dst"), "self_loop")
    for s in shares:
        error = error.when(~F.col(s).between(0, 1), f"{s}_range")
    return edges.select("src", "type", "dst", error.alias("error")).where("error is not null")
