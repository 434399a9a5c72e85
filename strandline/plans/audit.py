"""Queries over audits: ablation, density, rubrics, quality reports, guarded changes, overviews and nested reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.operators import audit as a
from strandline.operators import nested as n
from strandline.operators.components import shared_folder
from strandline.plans.cohort import query

_SOURCES = ["SNOMED-CT", "LOINC", "ICD-10", "HPO", "GO"]

# a node's sources as text, one letter each (S L I H G), so that both engines read the same rows
_NODES = """SELECT concat(CASE WHEN abnormal = 1 THEN 'S' ELSE '' END, CASE WHEN line % 2 = 0 THEN 'L' ELSE '' END, CASE WHEN line = 3 THEN 'H' ELSE '' END) AS codes, part % 7 = 0 AS generic, CASE WHEN line = 3 AND part % 2 = 0 THEN 'H' END AS created_by, true AS in_core FROM facts
    UNION ALL SELECT CASE WHEN dx = 'AD' THEN 'SI' WHEN dx = 'MCI' THEN 'S' ELSE '' END, status = 'F', NULL, true FROM visits
    UNION ALL SELECT CASE WHEN genotype IS NULL THEN '' ELSE 'G' END, false, CASE WHEN genotype = 'E4/E4' THEN 'G' END, false FROM patients"""
_EDGES = """SELECT CAST(NULL AS varchar) AS src_source, CASE WHEN line = 3 AND part % 2 = 0 THEN 'H' END AS dst_source, analyte <> 'NFL' AS has_uri FROM facts
    UNION ALL SELECT NULL, CASE WHEN dx = 'AD' THEN 'I' ELSE 'S' END, status <> 'O' FROM visits WHERE dx IN ('AD', 'MCI')
    UNION ALL SELECT CASE WHEN genotype = 'E4/E4' THEN 'G' END, 'L', true FROM patients"""
_LETTER = {"S": "SNOMED-CT", "L": "LOINC", "I": "ICD-10", "H": "HPO", "G": "GO"}


def _spark(t, sql: str):
    return t.spark.sql(sql.replace("varchar", "string").replace("FROM facts", "FROM {facts}").replace("FROM visits", "FROM {visits}").replace("FROM patients", "FROM {patients}"), facts=t.facts, visits=t.visits, patients=t.patients)


def _name(c: str):
    return F.element_at(F.create_map(*[F.lit(x) for kv in _LETTER.items() for x in kv]), F.col(c))


@query("m09_all_subsets", f"""WITH nd AS ({_NODES}), ed AS ({_EDGES}), m AS (SELECT unnest(range(32))::int AS mask), b AS (SELECT mask, concat(CASE WHEN mask & 1 > 0 THEN 'S' ELSE '' END, CASE WHEN mask & 2 > 0 THEN 'L' ELSE '' END, CASE WHEN mask & 4 > 0 THEN 'I' ELSE '' END, CASE WHEN mask & 8 > 0 THEN 'H' ELSE '' END, CASE WHEN mask & 16 > 0 THEN 'G' ELSE '' END) AS held FROM m),
    nc AS (SELECT mask, count(*) AS total, count(*) FILTER (WHERE ok) AS coded, count(*) FILTER (WHERE in_core) AS core, count(*) FILTER (WHERE in_core AND ok) AS core_ok FROM (SELECT mask, in_core, generic OR len(list_filter(string_split(codes, ''), lambda x: x <> '' AND contains(held, x))) > 0 AS ok FROM b, nd WHERE created_by IS NULL OR contains(held, created_by)) GROUP BY mask),
    ec AS (SELECT mask, count(ed.has_uri) AS total, count(*) FILTER (WHERE has_uri) AS uris FROM b LEFT JOIN ed ON (src_source IS NULL OR contains(held, src_source)) AND (dst_source IS NULL OR contains(held, dst_source)) GROUP BY mask),
    cc AS (SELECT mask, count(*) FILTER (WHERE contains(held, substring('SLIHG', 1 + n_regionkey, 1)))::bigint AS c FROM b, nation GROUP BY mask),
    j AS (SELECT b.mask, len(held) AS k, nc.total AS total, coded, core, core_ok, c, ec.total AS et, uris FROM b JOIN nc USING (mask) JOIN cc USING (mask) LEFT JOIN ec USING (mask)),
    s AS (SELECT *, round((coded + c) / (total + c), 4) AS node_coverage, CASE WHEN et = 0 THEN 0 ELSE uris / et END AS ev, (core_ok + c) / (core + c) AS fv, k / 5 AS kv FROM j)
    SELECT mask, total + c AS node_total, coded + c AS nodes_coded, node_coverage, et AS edge_total, uris AS edges_with_uri, round(ev, 4)::double AS edge_coverage,
        round((CASE WHEN fv >= 0.95 THEN 1 WHEN fv >= 0.5 THEN 0.5 ELSE 0 END + CASE WHEN ev >= 0.95 THEN 1 WHEN ev >= 0.5 THEN 0.5 ELSE 0 END + 2 * CASE WHEN kv >= 0.95 THEN 1 WHEN kv >= 0.5 THEN 0.5 ELSE 0 END + 8) / 13, 4)::double AS fair FROM s""")  # fmt: skip
def m09_all(t):
    """All subsets of five sources over facts, visits and patients."""
    codes = F.transform(F.filter(F.split("codes", ""), lambda c: c != ""), lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in _LETTER.items() for x in kv]), c))
    nodes = _spark(t, _NODES).select(codes.alias("codes"), "generic", _name("created_by").alias("created_by"), "in_core")
    edges = _spark(t, _EDGES).select(_name("src_source").alias("src_source"), _name("dst_source").alias("dst_source"), F.expr("CASE WHEN has_uri THEN 'u' END").alias("uri"))
    concepts = t.nation.select(F.get(F.array(*map(F.lit, _SOURCES)), F.col("n_regionkey")).alias("source"))
    return a.source_ablation(nodes, edges, concepts, _SOURCES).drop("sources")


_LABELS = """SELECT id, label, uri, name, 1 AS k FROM nodes UNION ALL SELECT id, 'Entity', uri, name, 2 FROM nodes WHERE label <> 'Visit' UNION ALL SELECT id, 'Concept', uri, name, 3 FROM nodes WHERE label IN ('Nation', 'Region') OR id LIKE 'P:%7'"""


@query("m01_multi_label", f"""WITH l AS ({_LABELS}), o AS (SELECT id, max((uri IS NOT NULL OR name = 'O' OR label = 'Concept')::int) AS ok FROM l GROUP BY 1), r AS (
    SELECT 'node' AS scope, label AS name, count(*) AS total, count(*) FILTER (WHERE uri IS NOT NULL OR name = 'O' OR label = 'Concept') AS with_uri FROM l GROUP BY label
    UNION ALL SELECT 'node', NULL, count(*), sum(ok)::bigint FROM o UNION ALL SELECT 'edge', type, count(*), count(uri) FROM edges GROUP BY type UNION ALL SELECT 'edge', NULL, count(*), count(uri) FROM edges)
    SELECT *, round(with_uri / total, 6) AS share FROM r""")  # fmt: skip
def m01_multi(t):
    labels = F.expr("array_compact(array(label, CASE WHEN label <> 'Visit' THEN 'Entity' END, CASE WHEN label IN ('Nation', 'Region') OR id LIKE 'P:%7' THEN 'Concept' END, label))")
    nodes = t.nodes.select(labels.alias("labels"), "uri", F.expr("CASE WHEN name = 'O' THEN 'x' END").alias("code"))
    return a.graph_density(nodes, t.edges, ["uri", "code"], ["uri"], "Concept")


_RUBRIC = [
    a.Principle("F1", "nodes", "try_divide(count(uri), count(*))", 0.3, 0.9), a.Principle("F2", "nodes", "try_divide(count(name), count(*))"), a.Principle("F3", "edges", "try_divide(count(uri), count(*))", 0.4, 0.9),
    a.Principle("F4", None, "Yes"), a.Principle("A1.1", None, "yes"), a.Principle("A1.2", None, "maybe"), a.Principle("A2", None, "partial"), a.Principle("I1", "edges", "try_divide(count(uri), count(*))"),
    a.Principle("I2", "nodes", "count(DISTINCT label)", 3, 5), a.Principle("I3", "edges", "count(DISTINCT type)", 4, 6), a.Principle("R1.1", "visits", "avg(CASE WHEN price > 0 THEN 1 ELSE 0 END)", 0.5, 1.0),
    a.Principle("R1.2", "visits", "try_divide(count(CASE WHEN dx = 'none' THEN 1 END), count(*))"), a.Principle("R1.3", "missing", "count(*)"),
]

_LEVELS = """SELECT 'F1' AS id, count(uri) / count(*) AS v, 0.3 AS p, 0.9 AS f FROM nodes UNION ALL SELECT 'F2', count(name) / count(*), 0.5, 0.95 FROM nodes UNION ALL SELECT 'F3', count(uri) / count(*), 0.4, 0.9 FROM edges UNION ALL SELECT 'I1', count(uri) / count(*), 0.5, 0.95 FROM edges
    UNION ALL SELECT 'I2', count(DISTINCT label)::double, 3, 5 FROM nodes UNION ALL SELECT 'I3', count(DISTINCT type)::double, 4, 6 FROM edges UNION ALL SELECT 'R1.1', avg((price > 0)::int), 0.5, 1 FROM visits UNION ALL SELECT 'R1.2', count(*) FILTER (WHERE dx = 'none') / count(*), 0.5, 0.95 FROM visits"""
_SCORED = f"""WITH m AS ({_LEVELS}), r AS (SELECT id, round(v, 6)::double AS measured, CASE WHEN v >= f THEN 'yes' WHEN v >= p THEN 'partial' ELSE 'no' END AS level FROM m UNION ALL SELECT * FROM (VALUES ('F4', NULL::double, 'yes'), ('A1.1', NULL, 'yes'), ('A1.2', NULL, 'no'), ('A2', NULL, 'partial'), ('R1.3', NULL, 'no'))),
    s AS (SELECT id, substring(id, 1, 1) AS dimension, measured, level, CASE level WHEN 'yes' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END::double AS score FROM r)"""


@query("m08_principles", f"{_SCORED} SELECT * FROM s")
def m08_principles(t):
    """Thirteen principles over three tables, four of them by hand."""
    return a.rubric_levels({"nodes": t.nodes, "edges": t.edges, "visits": t.visits}, _RUBRIC)


@query("m08_dimensions", f"{_SCORED} SELECT dimension, count(*) AS principles, round(avg(score), 6) AS score FROM s GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(score), 6) FROM s")
def m08_dimensions(t):
    return a.rubric_score(a.rubric_levels({"nodes": t.nodes, "edges": t.edges, "visits": t.visits}, _RUBRIC))


@query("m16_five_checks", """SELECT 'visits_without_facts' AS issue, count(*) AS n FROM visits WHERE vid NOT IN (SELECT vid FROM facts WHERE line = 2) UNION ALL SELECT 'visits_without_score', count(*) FROM visits WHERE mmse = 0
    UNION ALL SELECT 'patients_without_visits', count(*) FROM patients WHERE pid NOT IN (SELECT pid FROM visits WHERE dx = 'AD') UNION ALL SELECT 'missing_genotype', count(*) FROM patients WHERE genotype IS NULL UNION ALL SELECT 'orphan_facts', count(*) FROM facts WHERE vid NOT IN (SELECT vid FROM visits WHERE status = 'F')""")  # fmt: skip
def m16_five(t):
    """Five checks, each table read once; the samples are held against the conditions and left out."""
    flag = lambda rows, other, key, name: rows.join(other.select(key).distinct().withColumn(name, F.lit(1)), key, "left")
    tables = {
        "visits": flag(t.visits, t.facts.where("line = 2"), "vid", "seen"), "patients": flag(t.patients, t.visits.where("dx = 'AD'"), "pid", "seen"), "facts": flag(t.facts, t.visits.where("status = 'F'"), "vid", "seen"),
    }
    checks = [
        a.Check("visits_without_facts", "visits", "seen IS NULL", "vid"), a.Check("visits_without_score", "visits", "mmse = 0", "vid"), a.Check("patients_without_visits", "patients", "seen IS NULL", "pid"),
        a.Check("missing_genotype", "patients", "genotype IS NULL", "pid"), a.Check("orphan_facts", "facts", "seen IS NULL", "fid"),
    ]
    found = a.quality_report(tables, checks)
    return found.where(F.size("samples") == F.least(F.col("n"), F.lit(20))).select("issue", "n")


@query("m13_guarded_steps", "SELECT label, count(*) AS n, count(uri) AS with_uri FROM (SELECT label, CASE WHEN label = 'Nation' OR uri LIKE 'cohort:v%' THEN NULL ELSE uri END AS uri FROM nodes WHERE label <> 'Supplier') GROUP BY 1 UNION ALL SELECT type, count(*), count(uri) FROM edges WHERE type <> 'BASED_IN' GROUP BY 1")
def m13_guarded(t):
    """Three steps that hold are undone; a fourth, out of bounds, changes nothing."""
    folder = f"{shared_folder(t.spark)}/versions-{uuid.uuid4().hex}"
    a.publish({"nodes": t.nodes, "edges": t.edges}, folder)
    suppliers = t.supplier.count()
    a.roll_back(t.spark, folder, [
        a.Step("suppliers", "nodes", "label = 'Supplier'", suppliers, suppliers), a.Step("their edges", "edges", "type = 'BASED_IN'", suppliers, suppliers),
        a.Step("concept uris", "nodes", "label = 'Nation' AND uri IS NOT NULL", 25, 25, "uri"), a.Step("visit uris", "nodes", "uri LIKE 'cohort:v%'", 0, 1 << 62, "uri"),
    ])
    try:
        a.roll_back(t.spark, folder, [a.Step("visits", "nodes", "label = 'Visit'", 0, 1 << 62), a.Step("regions", "nodes", "label = 'Region'", 6, 9)])
    except a.GuardError:
        pass
    now = a.current_version(t.spark, folder)
    count = lambda rows, by: rows.groupBy(F.col(by).alias("label")).agg(F.count("*").alias("n"), F.count("uri").alias("with_uri"))
    return count(now["nodes"], "label").unionByName(count(now["edges"], "type"))


#: (kind, table, condition, label) of the twelve kinds of the overview.
_KINDS = [
    ("visits", "visits", "true", "status"), ("diagnoses", "visits", "dx <> 'CN'", "dx"), ("assessments", "visits", "mmse > 0", "CASE WHEN mmse >= 24 THEN 'none' WHEN mmse >= 18 THEN 'mild' ELSE 'severe' END"), ("priorities", "visits", "price > 100000", "priority"),
    ("biomarkers", "facts", "true", "analyte"), ("abnormal", "facts", "abnormal = 1", "analyte"), ("amyloid", "facts", "analyte LIKE 'ABETA%'", "analyte"), ("tau", "facts", "analyte LIKE '%TAU'", "analyte"),
    ("late_facts", "facts", "months > 24", "CAST(line AS varchar)"), ("baseline", "visits", "months = 0", "dx"), ("followups", "visits", "months > 0", "dx"), ("genotypes", "patients", "genotype IS NOT NULL", "genotype"),
]


@query("d30_twelve_kinds", "WITH k AS (" + " UNION ALL ".join(f"SELECT pid, '{k}' AS kind, {label} AS label FROM {table} WHERE {where}" for k, table, where, label in _KINDS) + "), n AS (SELECT unnest([" + ", ".join(f"'{k[0]}'" for k in _KINDS) + """]) AS kind)
    SELECT p.pid, p.gender, p.age, n.kind, count(k.kind) AS n, coalesce(string_agg(DISTINCT k.label, ',' ORDER BY k.label), '') AS list FROM patients p CROSS JOIN n LEFT JOIN k ON k.pid = p.pid AND k.kind = n.kind GROUP BY ALL""")
def d30_twelve(t):
    """Each patient's overview, one row a kind."""
    kinds = {k: (getattr(t, table), F.expr(label.replace("varchar", "string")), F.expr(where)) for k, table, where, label in _KINDS}
    rows = n.overview(t.patients.select("pid", "gender", "age"), "pid", kinds)
    return rows.select("pid", "gender", "age", F.explode("facts").alias("kind", "f")).select("pid", "gender", "age", "kind", "f.n", F.array_join("f.list", ",").alias("list"))


@query("k07_any_depth", """WITH v AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY vid) - 1 AS i FROM visits) SELECT pid, 'who.gender' AS path, gender AS value FROM patients UNION ALL SELECT pid, 'who.genes.genotype', genotype FROM patients UNION ALL SELECT pid, 'who.genes.flags[1][0]', (age % 2)::varchar FROM patients UNION ALL SELECT pid, 'who.genes.flags[0]', 'true' FROM patients
    UNION ALL SELECT pid, concat('visits[', i, '].dx'), dx FROM v UNION ALL SELECT pid, concat('visits[', i, '].scores.mmse'), mmse::varchar FROM v""")
def k07_any(t):
    """A nested report of each patient, read back as paths."""
    visits = t.visits.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("vid", "dx", "mmse"))).alias("v"))
    lines = F.transform(F.coalesce("v", F.expr("array()").cast("array<struct<vid:bigint,dx:string,mmse:int>>")), lambda x: F.concat(F.lit('{"dx":'), to_json_text(x["dx"]), F.lit(',"scores":{"mmse":'), x["mmse"].cast("string"), F.lit("}}")))
    genes = F.concat(F.lit('"genes":{"genotype":'), F.coalesce(to_json_text(F.col("genotype")), F.lit("null")), F.lit(',"none":{},"flags":[true,['), (F.col("age") % 2).cast("string"), F.lit("]]}"))
    text = F.concat(F.lit('{"who":{"gender":'), to_json_text(F.col("gender")), F.lit(","), genes, F.lit('},"visits":['), F.array_join(lines, ","), F.lit("]}"))
    return n.flatten_json(t.patients.join(visits, "pid", "left").select("pid", text.alias("report")), "pid", "report")


def to_json_text(c):
    """A text as a JSON string; null stays null."""
    return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
