"""Audits: brute force over small tables, odd rows, refused changes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import audit, nested
from strandline.operators.audit import Check, GuardError, Principle, Step


def test_ablation_against_each_subset(spark):
    rnd = random.Random(1)
    sources = ["A", "B", "C"]
    some = lambda: rnd.choice([None, "A", "B", "C", "X"])
    nodes = [(rnd.choice([None, [], ["A"], ["B", "C"], ["A", "X"], [None, "C"]]), rnd.choice([None, True, False]), some(), rnd.choice([None, True])) for _ in range(200)]
    edges = [(some(), some(), rnd.choice([None, "u"])) for _ in range(200)]
    concepts = [(some(),) for _ in range(50)]
    frames = (spark.createDataFrame(nodes, "codes array<string>, generic boolean, created_by string, in_core boolean"), spark.createDataFrame(edges, "src_source string, dst_source string, uri string"), spark.createDataFrame(concepts, "source string"))
    got = {tuple(r.sources): r for r in audit.source_ablation(*frames, sources, ["A", "C"]).collect()}
    assert len(got) == 8
    level = lambda v: 1.0 if v >= 0.95 else 0.5 if v >= 0.5 else 0.0
    for k in range(4):
        for kept in itertools.combinations(sources, k):
            there = lambda s: s is None or s in kept  # noqa: B023, E731
            alive = [n for n in nodes if there(n[2])]
            coded = [n for n in alive if n[1] or any(c in kept for c in n[0] or [])]
            own = sum(c in kept for (c,) in concepts)
            e = [x for x in edges if there(x[0]) and there(x[1])]
            core, core_ok = sum(bool(n[3]) for n in alive) + own, sum(bool(n[3]) for n in coded) + own
            r = got[kept]
            assert (r.node_total, r.nodes_coded, r.edge_total, r.edges_with_uri) == (len(alive) + own, len(coded) + own, len(e), sum(x[2] is not None for x in e))
            five = sum(s in kept for s in ("A", "C")) / 2
            assert r.fair == round((level(core_ok / core) + level(r.edges_with_uri / r.edge_total if e else 0) + 2 * level(five) + 8) / 13, 4)
    none = audit.source_ablation(*(f.limit(0) for f in frames), sources).collect()
    assert len(none) == 8 and {r.node_coverage for r in none} == {0.0}
    with pytest.raises(ValueError):
        audit.source_ablation(*frames, [str(i) for i in range(17)])


def test_density_counts_each_node_once_overall(spark):
    nodes = spark.createDataFrame([(["P", "Q"], "u", None), (["P", "P"], None, "c"), (["Concept"], None, None), ([], "u", None), (None, None, None), (["Q", None], None, None)], "labels array<string>, uri string, code string")
    edges = spark.createDataFrame([("T", "u"), ("T", None), (None, "u")], "type string, uri string")
    got = {(r.scope, r.name): (r.total, r.with_uri) for r in audit.graph_density(nodes, edges, ["uri", "code"], ["uri"], "Concept").collect()}
    assert got == {("node", "P"): (2, 2), ("node", "Q"): (2, 1), ("node", "Concept"): (1, 1), ("node", None): (6, 4), ("edge", "T"): (2, 1), ("edge", None): (2, 1)}
    empty = audit.graph_density(nodes.limit(0), edges.limit(0), ["uri"], ["uri"]).collect()
    assert sorted((r.scope, r.name, r.total, r.share) for r in empty) == [("edge", None, 0, 0.0), ("node", None, 0, 0.0)]


def test_rubric_levels(spark):
    t = spark.createDataFrame([(1, None), (2, "u"), (3, "u"), (4, "u")], "i int, uri string")
    rubric = [Principle("F1", "t", "try_divide(count(uri), count(*))"), Principle("F2", "t", "max(i)", 4, 9), Principle("A1", "t", "max(i)", 1, 4), Principle("A2", None, "YES"), Principle("I1", None, "?"), Principle("I2", "none", "count(*)"), Principle("R1", "t", "max(CASE WHEN i > 9 THEN i END)"), Principle("R2", "t", "double('NaN')")]
    got = {r.id: (r.measured, r.level) for r in audit.rubric_levels({"t": t}, rubric).collect() if r.id != "R2"}
    assert got == {"F1": (0.75, "partial"), "F2": (4.0, "partial"), "A1": (4.0, "yes"), "A2": (None, "yes"), "I1": (None, "no"), "I2": (None, "no"), "R1": (None, "no")}
    scores = {r.dimension: (r.principles, r.score) for r in audit.rubric_score(audit.rubric_levels({"t": t}, rubric)).collect()}
    assert scores == {"F": (2, 0.5), "A": (2, 1.0), "I": (2, 0.0), "R": (2, 0.0), "all": (8, 0.375)}
    assert audit.rubric_levels({"t": t.limit(0)}, rubric[:1]).first().level == "no"


def test_quality_report_samples(spark):
    rows = spark.createDataFrame([(i % 40, None if i % 3 else i) for i in range(120)] + [(None, None)], "key int, v int").repartition(5)
    checks = [Check("null", "t", "v IS NULL", "key"), Check("never", "t", "v < 0", "key"), Check("unknown", "t", "v > v", "key")]
    got = {r.issue: r for r in audit.quality_report({"t": rows, "other": rows}, checks, 7).collect()}
    assert got["null"].n == 81 and got["never"].n == 0 and got["never"].samples == [] and got["unknown"].n == 0
    order = [r.k for r in rows.where("v is null and key is not null").select(F.col("key").cast("string").alias("k"), F.xxhash64(F.col("key").cast("string")).alias("h")).distinct().orderBy("h").collect()]
    kept = [k for k in order[:7]]
    assert set(got["null"].samples) <= set(kept) and len(got["null"].samples) >= 6  # the null key may take a place
    assert audit.quality_report({"t": rows.limit(0)}, checks).count() == 3


def test_guarded_changes(spark, tmp_path):
    folder = str(tmp_path / "g")
    nodes = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", None), (3, "b", None), (4, None, "y")], "id int, kind string, code string")
    audit.publish({"nodes": nodes, "edges": nodes.select("id")}, folder)
    steps = [Step("drop a", "nodes", "kind = 'a'", 1, 1), Step("clear", "nodes", "code = 'x'", 1, 1, "code")]
    assert [tuple(r) for r in audit.roll_back(spark, folder, steps, dry_run=True).collect()] == [("drop a", 1, 4), ("clear", 1, 4)]
    assert audit.current_version(spark, folder)["nodes"].count() == 5
    audit.roll_back(spark, folder, steps)
    now = audit.current_version(spark, folder)
    assert sorted((r.id, r.code) for r in now["nodes"].where("code is not null").collect()) == [(4, "y")] and now["nodes"].count() == 4 and now["edges"].count() == 5
    with pytest.raises(GuardError):
        audit.roll_back(spark, folder, [Step("drop y", "nodes", "code = 'y'", 1, 1), Step("none", "nodes", "kind = 'zzz'", 1, 5)])
    assert audit.current_version(spark, folder)["nodes"].where("code = 'y'").count() == 1


def test_flatten_json(spark):
    rows = [(1, '{"a": {"b": [1, {"c": null}], "e": {}, "f": []}, "g.h": "x"}'), (2, "7"), (3, None), (4, "{broken"), (5, "[]"), (6, '[[["deep"]], true, 1.5]'), (7, '{"a":1,"a":2}')]
    got = sorted((r.id, r.path, r.value) for r in nested.flatten_json(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect())
    assert [x for x in got if x[0] < 7] == [(1, "a.b[0]", "1"), (1, "a.b[1].c", None), (1, "g.h", "x"), (2, "", "7"), (6, "[0][0][0]", "deep"), (6, "[1]", "true"), (6, "[2]", "1.5")]
    assert nested.flatten_json(spark.createDataFrame(rows, "id int, j string").limit(0), "id", "j").count() == 0


def test_overview(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "pid int, name string")
    facts = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (1, None), (None, "z"), (9, "q")], "pid int, label string")
    got = {r.name: r.facts for r in nested.overview(base, "pid", {"f": (facts, "label"), "n": (facts, None)}, 1).collect()}
    assert got["a"]["f"].n == 4 and got["a"]["f"].list == ["x"] and got["a"]["n"].n == 4 and got["a"]["n"].list == []
    assert got["b"]["f"].n == 0 and got["b"]["f"].list == [] and got["c"]["f"].n == 0


def test_backdoor_sets(spark):
    from strandline.operators import causal

    rnd = random.Random(2)
    rows = []
    for _ in range(400):
        c, d = rnd.gauss(0, 1), rnd.gauss(0, 1)
        t = 2 * c - d + rnd.gauss(0, 0.5)
        rows.append((c, d, t, 3 * t + 5 * c + 2 * d))
    df = spark.createDataFrame(rows, "c double, d double, t double, y double")
    edges = spark.createDataFrame([("c", "t"), ("d", "t"), ("c", "y"), ("d", "y"), ("t", "y"), ("t", "t"), (None, "t")], "source string, target string")
    assert causal.backdoor_set(edges, "t", "y", df.columns) == ["c", "d"]
    assert causal.backdoor_effect(df, edges, "t", "y").first().effect == pytest.approx(3, abs=1e-5)
    assert causal.backdoor_effect(df, edges.limit(0), "t", "y").first().effect != pytest.approx(3, abs=0.1)
    more = lambda *pairs: edges.unionByName(spark.createDataFrame(list(pairs), "source string, target string"))
    for wrong in (more(("y", "t")), more(("y", "c")), more(("h", "t"))):
        with pytest.raises(ValueError):
            causal.backdoor_set(wrong, "t", "y", df.columns)


def test_edge_scores_count_undirected_edges_both_ways(spark):
    from strandline.operators import causal

    found = spark.createDataFrame([("a", "b", "directed"), ("b", "c", "undirected"), ("b", "c", "undirected"), ("x", "y", "directed"), (None, "y", "directed")], "source string, target string, direction string")
    truth = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e")], "source string, target string")
    assert tuple(causal.edge_scores_either_way(found, truth).first()) == (0.5, 0.666667, 0.571429, 3, 4, 3)
    assert tuple(causal.edge_scores_either_way(found.limit(0), truth.limit(0)).first()) == (0.0, 0.0, 0.0, 0, 0, 0)


@pytest.mark.parametrize("hub", [1, 3, 10**9])
def test_reach_by_rows_and_bitmaps(spark, hub):
    from strandline.operators import graph

    rnd = random.Random(5)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)] + [(0, i) for i in range(1, 30)] + [(50, 50), (None, 3)]
    edges = spark.createDataFrame([(a, "t", b) for a, b in pairs], "src int, type string, dst int")
    near = {}
    for a, b in pairs:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {a: len((near[a] | {y for x in near[a] for y in near[x]}) - {a}) for a in near}
    seeds = spark.createDataFrame([(i,) for i in [*range(60), 0, None]], "id int")
    got = {r.id: r.reach for r in graph.reach(edges, seeds, hub).collect()}
    assert got == want
    assert graph.reach(edges.limit(0), seeds).count() == 0
    histogram = {r.bucket: r.seeds for r in graph.reach_histogram(spark.createDataFrame([(1, 5), (2, 5), (3, 99), (4, 100), (5, 250)], "id int, reach int")).collect()}
    assert histogram == {5: 2, 99: 1, 100: 1, 200: 1}


def test_reach_keeps_only_edges_near_seeds(spark, monkeypatch):
    from strandline.operators import graph

    edges = spark.createDataFrame([(1, "t", 0), (2, "t", 0), (3, "t", 0), (3, "t", 4), (4, "t", 5), (5, "t", 6)], "src int, type string, dst int")
    seen, number = [], graph.dense_ids
    monkeypatch.setattr(graph, "dense_ids", lambda nodes, column: (seen.extend(r[0] for r in nodes.select(column).distinct().collect()), number(nodes, column))[1])
    got = {r.id: r.reach for r in graph.reach(edges, spark.createDataFrame([(1,), (2,)], "id int"), 1).collect()}
    assert got == {1: 3, 2: 3} and sorted(seen) == [0, 1, 2, 3]


def test_overview_of_kinds_of_one_table(spark):
    base = spark.createDataFrame([(1,), (2,)], "pid int")
    facts = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", None), (2, None, 2), (None, "z", 1)], "pid int, label string, v int")
    df = nested.overview(base, "pid", {"ones": (facts, "label", F.expr("v = 1")), "twos": (facts, F.expr("upper(label)"), F.expr("v = 2")), "all": (facts, None)})
    got = {r.pid: {k: (f.n, f.list) for k, f in r.facts.items()} for r in df.collect()}
    assert got == {1: {"ones": (1, ["x"]), "twos": (1, ["Y"]), "all": (3, [])}, 2: {"ones": (0, []), "twos": (1, []), "all": (1, [])}}


def test_facts_by_visit(spark, sf_dir):
    from strandline.plans.cohort import Cohort

    t = Cohort(spark, sf_dir)
    assert t.facts.exceptAll(t.facts_by_visit).count() == 0 and t.facts_by_visit.count() == t.facts.count()
    assert "REPARTITION_BY_NUM" in t.facts_by_visit._jdf.queryExecution().executedPlan().toString()
