"""Queries over the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import graph as g
from strandline.plans.cohort import query

_ENDS = "SELECT src AS id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges"


@query("g01_degree", f"SELECT label, count(*) AS n, round(avg(degree), 6) AS mean, max(degree) AS most FROM nodes JOIN (SELECT id, count(*) AS degree FROM ({_ENDS}) GROUP BY 1) USING (id) GROUP BY 1")
def g01(t):
    return t.nodes.join(g.degrees(t.edges), "id").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("degree"), 6).alias("mean"), F.max("degree").alias("most"))


@query("g02_hubs", "SELECT dst AS id, count(*) AS in_degree FROM edges WHERE type IN ('LIVES_IN', 'BASED_IN', 'IS_A') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def g02(t):
    return g.hubs(t.edges, ["LIVES_IN", "BASED_IN", "IS_A"], 25)


@query("g03_isolated", "SELECT label, count(*) AS n FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges) GROUP BY 1")
def g03(t):
    return g.isolated(t.nodes, t.edges).groupBy("label").agg(F.count("*").alias("n"))


@query("g04_connected_components", """WITH RECURSIVE links AS (SELECT DISTINCT n_nationkey AS a, n_regionkey AS b FROM nation) SELECT concat('N:', min(n_nationkey)) AS smallest, count(*) + 1 AS size FROM nation GROUP BY n_regionkey""")
def g04(t):
    sizes = g.connected_components(t.edges.where("type = 'IS_A'")).groupBy("component").agg(F.count("*").alias("size"), F.min(F.when(F.col("id").startswith("N:"), F.substring("id", 3, 9).cast("int"))).alias("k"))
    return sizes.select(F.concat(F.lit("N:"), "k").alias("smallest"), "size")


@query("g04_all_components")
def g04b(t):
    return g.component_sizes(t.edges, 25)


@query("g05_bounded_paths", "SELECT a.src AS first, a.dst AS last, 1 AS length FROM edges a UNION ALL SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src UNION ALL SELECT a.src, c.dst, 3 FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src")
def g05(t):
    return g.paths(t.edges, 3).select("first", "last", "length")


@query("g06_paths_with_cost", """SELECT first, last, path, cost FROM (SELECT a.f AS first, a.l AS last, concat(a.f, '>', a.l) AS path, a.c AS cost FROM st a UNION ALL SELECT a.f, b.l, concat(a.f, '>', a.l, '>', b.l), a.c + b.c FROM st a JOIN st b ON a.l = b.f AND b.l <> a.f) WHERE first = 'CN' AND last = 'AD'""".replace("SELECT first", "WITH st AS (SELECT f, l, min(gap)::double AS c FROM (SELECT lag(dx) OVER w AS f, dx AS l, months - lag(months) OVER w AS gap FROM visits WINDOW w AS (PARTITION BY pid ORDER BY months, vid)) WHERE f <> l GROUP BY ALL) SELECT first", 1))
def g06(t):
    from strandline.operators.relational import changes

    step = changes(t.visits, ["pid"], ["months", "vid"], "dx").groupBy(F.col("from_value").alias("src"), F.col("dx").alias("dst")).agg(F.min(F.expr("months - prior_months")).alias("c"))
    start = t.spark.createDataFrame([("CN",)], "id string")
    return g.paths(step, 2, start, weight="c").where("last = 'AD'").select("first", "last", F.array_join("path", ">").alias("path"), "cost")


@query("g07_shortest_path", f"""WITH e AS (SELECT DISTINCT * FROM ({_ENDS})), h1 AS (SELECT DISTINCT other AS id FROM e WHERE id = 'R:1'), h2 AS (SELECT DISTINCT e.other AS id FROM h1 JOIN e ON h1.id = e.id), h3 AS (SELECT DISTINCT e.other AS id FROM h2 JOIN e ON h2.id = e.id)
    SELECT id, cast(min(h) AS int) AS hops FROM (SELECT 'R:1' AS id, 0 AS h UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) GROUP BY 1""")  # fmt: skip
def g07(t):
    return g.shortest_paths(t.edges, "R:1", 3)


@query("g08_neighbourhood", "SELECT src, type, dst FROM edges WHERE (src = 'P:7' AND type <> 'X') OR (type = 'LIVES_IN' AND src = 'P:7')")
def g08(t):
    return g.neighbourhood(t.edges, "P:7", 1).select("src", "type", "dst")


@query("g09_hierarchy_closure", "SELECT src AS descendant, dst AS ancestor, 1 AS depth FROM edges WHERE type = 'IS_A'")
def g09(t):
    return g.closure(t.edges, "IS_A", 3)


@query("g10_density", "SELECT n, e, round(e / (n * (n - 1)), 9) AS density, round(2 * e / n, 6) AS avg_degree FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS e FROM edges)")
def g10(t):
    return g.density(t.nodes, t.edges)


@query("g11_schema_patterns", "SELECT a.label AS src_label, type, b.label AS dst_label, count(*) AS n FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id GROUP BY ALL HAVING count(*) > 50")
def g11(t):
    return g.patterns(t.nodes, t.edges, 50)


@query("g12_parallel_edges", "SELECT kind AS type, (count(*) - count(DISTINCT (a, b)))::bigint AS extra FROM (SELECT concat('analyte ', analyte) AS kind, pid AS a, part AS b FROM facts) GROUP BY 1")
def g12(t):
    return g.parallel_edges(t.facts.select(F.col("pid").alias("src"), F.concat(F.lit("analyte "), "analyte").alias("type"), F.col("part").alias("dst")))


@query("g13_reach", f"""WITH e AS (SELECT DISTINCT * FROM ({_ENDS})), s AS (SELECT id FROM nodes WHERE label = 'Supplier'), r AS (SELECT s.id, e.other FROM s JOIN e ON s.id = e.id UNION SELECT s.id, f.other FROM s JOIN e ON s.id = e.id JOIN e f ON e.other = f.id) SELECT id, count(*) AS reach FROM r WHERE id <> other GROUP BY 1""")
def g13(t):
    return g.reach(t.edges, t.nodes.where("label = 'Supplier'"))


@query("g14_ontology_chain", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'LIVES_IN' AND b.type = 'IS_A'")
def g14(t):
    return g.chain(t.edges, "LIVES_IN", "IS_A")


@query("g16_ego", "SELECT 'N:3' AS id, CASE WHEN e.src = 'N:3' THEN 'out' ELSE 'in' END AS direction, type, CASE WHEN e.src = 'N:3' THEN dst ELSE src END AS other, label, coalesce(name, id) AS display FROM edges e LEFT JOIN (SELECT id AS nid, * FROM nodes) n ON n.nid = CASE WHEN e.src = 'N:3' THEN dst ELSE src END WHERE e.src = 'N:3' OR e.dst = 'N:3'".replace("coalesce(name, id)", "coalesce(n.name, n.nid)"))
def g16(t):
    return g.ego(t.edges, t.nodes, "N:3")


@query("g17_typed_family", "SELECT pid AS src, CASE WHEN pid % 2 = 0 THEN 'HAS_PARENT' ELSE 'HAS_SIBLING' END AS type, pid + 1 AS dst FROM patients UNION ALL SELECT pid + 1, CASE WHEN pid % 2 = 0 THEN 'HAS_CHILD' ELSE 'HAS_SIBLING' END, pid FROM patients")
def g17(t):
    members = t.patients.select(F.col("pid").alias("a"), F.expr("CASE WHEN pid % 2 = 0 THEN 'parent' ELSE 'sibling' END").alias("relation"), F.expr("pid + 1").alias("b"))
    return g.typed_edges(members, {"parent": ("HAS_PARENT", "HAS_CHILD"), "sibling": ("HAS_SIBLING", "HAS_SIBLING")})


@query("g18_missing_inverses", "SELECT dst AS src, 'IS_VISIT_OF' AS type, src AS dst FROM edges WHERE type = 'HAS_VISIT'")
def g18(t):
    return g.missing_inverses(t.edges, {"HAS_VISIT": "IS_VISIT_OF"})


_STEPS = "SELECT DISTINCT concat('S', a) AS src, concat('S', b) AS dst FROM (SELECT lag(dx) OVER w AS a, dx AS b FROM visits WINDOW w AS (PARTITION BY pid ORDER BY months, vid)) WHERE a IS NOT NULL"


def _states(t):
    from pyspark.sql import Window

    prior = F.lag("dx").over(Window.partitionBy("pid").orderBy("months", "vid"))
    return t.visits.select(F.concat(F.lit("S"), prior).alias("src"), F.concat(F.lit("S"), "dx").alias("dst")).where("src is not null")


@query("g19_cycles", f"{_STEPS} UNION ALL SELECT concat('M', p_partkey), concat('N', p_partkey) FROM part UNION ALL SELECT concat('N', p_partkey), concat('M', p_partkey) FROM part")
def g19(t):
    """Cycles of states and of two nodes a part; the edges from one part's cycle to the states' and the tree lie on none."""
    tree = t.edges.where("type = 'IS_A'").select("src", "dst")
    m, n = F.concat(F.lit("M"), "p_partkey"), F.concat(F.lit("N"), "p_partkey")
    pairs = t.part.select(F.explode(F.array(F.struct(m.alias("src"), n.alias("dst")), F.struct(n.alias("src"), m.alias("dst")), F.struct(n.alias("src"), F.lit("SCN").alias("dst")))).alias("e")).select("e.*")
    return g.on_cycles(_states(t).unionByName(tree).unionByName(pairs))


@query("g19_circular_paths", f"""WITH st AS (SELECT src AS s, dst AS d FROM ({_STEPS}) WHERE src <> dst) SELECT concat_ws('>', a.s, b.s) AS path, 2 AS length FROM st a JOIN st b ON a.d = b.s AND b.d = a.s WHERE a.s < b.s
    UNION ALL SELECT concat_ws('>', a.s, b.s, c.s), 3 FROM st a JOIN st b ON a.d = b.s JOIN st c ON b.d = c.s AND c.d = a.s WHERE a.s < b.s AND a.s < c.s AND b.s <> c.s
    UNION ALL SELECT concat_ws('>', a.s, b.s, c.s, e.s), 4 FROM st a JOIN st b ON a.d = b.s JOIN st c ON b.d = c.s JOIN st e ON c.d = e.s AND e.d = a.s WHERE a.s < b.s AND a.s < c.s AND a.s < e.s AND b.s <> c.s AND b.s <> e.s AND c.s <> e.s""")  # fmt: skip
def g19b(t):
    return g.circular_paths(_states(t)).select(F.array_join("path", ">").alias("path"), "length")


@query("g20_edge_integrity", "SELECT pid AS src, 'NEAR' AS type, nation::bigint AS dst, CASE WHEN pid = nation THEN 'self_loop' ELSE 'strength_range' END AS error FROM patients WHERE pid = nation OR acctbal / 9000 NOT BETWEEN 0 AND 1")
def g20(t):
    edges = t.patients.select(F.col("pid").alias("src"), F.lit("NEAR").alias("type"), F.col("nation").cast("long").alias("dst"), F.expr("acctbal / 9000").alias("strength"))
    return g.edge_errors(edges, "strength")
