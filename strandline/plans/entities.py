"""Queries over entity extraction, files, exports, ontology edges and validity keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.operators import causal as x
from strandline.operators import ontology as o
from strandline.operators.components import shared_folder
from strandline.plans.causal import _ALG, _algorithms
from strandline.plans.cohort import query
from strandline.sources import entities as e
from strandline.sources import files


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _write_files(folder: str):
    """A file for each id: dicom and nifti by suffix, marked and unmarked files without one, dot files, and such as don't count."""

    def run(batches):
        import pyarrow as pa

        fs, path = files.open_store(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                name, size = [(f"d{i}.dcm", 9), (f"n{i}.nii.gz", 9), (f"m{i}", 100_200), (f"u{i}", 100_200), (f".h{i}.dcm", 9), (f"t{i}.txt", 9), (f"s{i}", 300)][i % 7]
                place = f"{path}/site{i % 3}/" + ("thumbnails" if i % 21 == 0 else f"subject{i % 11}")
                fs.create_dir(place, recursive=True)
                with fs.open_output_stream(f"{place}/{name}", compression=None) as out:
                    data = bytearray(size)
                    if i % 7 in (2, 6) and size > 132:
                        data[128:132] = b"DICM"
                    out.write(bytes(data))
            yield pa.record_batch([batch.column(0)], names=["id"])

    return run


@query("s10_image_files", "SELECT CASE s_suppkey % 7 WHEN 1 THEN 'nifti' ELSE 'dicom' END AS kind, count(*) AS n, sum(CASE WHEN s_suppkey % 7 = 2 THEN 100200 ELSE 9 END)::bigint AS bytes FROM supplier WHERE s_suppkey % 7 < 3 AND s_suppkey % 21 <> 0 GROUP BY 1")
def s10_files(t):
    """A file a supplier, listed by tasks."""
    folder = _folder(t, "images")
    t.supplier.select("s_suppkey").mapInArrow(_write_files(folder), "id long").write.format("noop").mode("overwrite").save()
    return files.image_files(t.spark, folder, 4).groupBy("kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def _sessions(t):
    """The visits as a wide table of sessions."""
    v = t.visits.join(t.patients.select("pid", "gender", "edu", "age"), "pid")
    null = lambda c: F.expr(c)
    return v.select(
        F.col("pid").alias("Subject ID"), null("CASE WHEN vid % 9 <> 0 THEN concat('MR', vid) END").alias("MRI ID"), F.col("months").alias("Visit"), F.col("dx").alias("Group"), F.col("gender").alias("M/F"), F.lit("R").alias("Hand"), F.col("age").alias("Age"), F.col("edu").alias("EDUC"), F.lit("").alias("SES"),
        F.lit(None).cast("string").alias("MR Delay"), null("CASE WHEN mmse > 3 THEN mmse END").alias("MMSE"), null("CASE WHEN vid % 4 > 0 THEN vid % 4 / 2 - 0.5 END").alias("CDR"), null("CASE WHEN status = 'F' THEN 0.7 END").alias("nWBV"), F.lit(1500).alias("eTIV"), F.lit(None).cast("string").alias("ASF"),
    )


_SESSION = "WITH s AS (SELECT vid, v.pid, months, dx, status, mmse, gender, edu FROM visits v JOIN patients p ON v.pid = p.pid WHERE vid % 9 <> 0)"


@query("s06_six_entities", f"""{_SESSION} SELECT 'Patient' AS kind, pid::varchar AS key, 3::int AS n, edu::varchar AS value FROM s GROUP BY pid, edu UNION ALL SELECT 'Visit', concat('MR', vid), 3, dx FROM s UNION ALL SELECT 'Diagnosis', concat('dx_MR', vid), 3, CASE WHEN vid % 4 = 1 THEN 'CN' ELSE 'AD' END FROM s WHERE vid % 4 > 0
    UNION ALL SELECT 'CognitiveAssessment', concat('MR', vid, '_MMSE'), 2, mmse::varchar FROM s WHERE mmse > 3 UNION ALL SELECT 'CognitiveAssessment', concat('MR', vid, '_CDR'), 2, CASE vid % 4 WHEN 1 THEN '0.0' WHEN 2 THEN '0.5' ELSE '1.0' END FROM s WHERE vid % 4 > 0 UNION ALL SELECT 'BrainRegion', concat('MR', vid, '_Whole Brain'), 3, '0.7' FROM s WHERE status = 'F'""")  # fmt: skip
def s06_six(t):
    """All kinds of the second cohort, with the number of properties and one of them."""
    found, _ = e.session_entities(_sessions(t), "second")
    shown = F.coalesce(*[F.try_element_at("properties", F.lit(p)) for p in ("educ", "diagnosis_code", "value", "nwbv", "group")])
    shown = F.when(F.col("kind") == "CognitiveAssessment", F.col("properties")["value"].cast("double").cast("string")).otherwise(shown)
    return found.select("kind", "key", F.size("properties").alias("n"), F.when(F.col("key").endswith("_MMSE"), F.col("properties")["value"]).otherwise(shown).alias("value"))


@query("s06_edges", f"{_SESSION} SELECT 'HAS_VISIT' AS type, count(*) AS n, count(DISTINCT pid) AS sources FROM s UNION ALL SELECT 'HAS_DIAGNOSIS', count(*), count(*) FROM s WHERE vid % 4 > 0 UNION ALL SELECT 'HAS_COGNITIVE_ASSESSMENT', (SELECT count(*) FROM s WHERE mmse > 3) + (SELECT count(*) FROM s WHERE vid % 4 > 0), count(*) FROM s WHERE mmse > 3 OR vid % 4 > 0 UNION ALL SELECT 'HAS_IMAGE', count(*), count(*) FROM s WHERE status = 'F'")
def s06_edges(t):
    _, edges = e.session_entities(_sessions(t), "second")
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


@query("s11_entity_tables", """SELECT 'Patient' AS kind, 'customer' AS source_table, count(*) AS total_rows, count(genotype) AS written_rows, 'b1' AS batch_id FROM patients UNION ALL SELECT 'Visit', 'orders', 2 * count(*), count(*), 'b1' FROM visits UNION ALL SELECT 'Biomarker', 'lineitem', count(*), count(DISTINCT (fid, vid, analyte, value)), 'b1' FROM facts
    UNION ALL SELECT 'Diagnosis', 'orders', count(*), count(*), 'b1' FROM visits WHERE dx <> 'CN' UNION ALL SELECT 'Supplier', 'supplier', count(*), count(*), 'b1' FROM supplier""")  # fmt: skip
def s11_tables(t):
    """Five kinds of one batch, written twice; visits come twice, patients without genotype aren't whole."""
    visits = t.visits.select("vid", "pid", "months", "status")
    tables = {
        "Patient": (t.patients.select("pid", "gender", "genotype"), "customer"), "Visit": (visits.unionByName(visits), "orders"), "Biomarker": (t.facts.select("fid", "vid", "analyte", "value"), "lineitem"),
        "Diagnosis": (t.visits.where("dx <> 'CN'").select(F.concat(F.lit("dx_"), "vid").alias("id"), "dx"), "orders"), "Supplier": (t.supplier.select("s_suppkey", "s_name"), "supplier"),
    }
    folder = _folder(t, "entities")
    e.write_entity_tables(tables, folder, "b1", {"Patient": ["pid", "genotype"]})
    return e.write_entity_tables(tables, folder, "b1", {"Patient": ["pid", "genotype"]})


@query("s12_audit_csv", "SELECT dx, n::varchar AS n, status, note FROM (SELECT dx, count(*) AS n, string_agg(DISTINCT status, '|' ORDER BY status) AS status, concat('he said \"', dx, '\", twice') AS note FROM visits GROUP BY 1)")
def s12_csv(t):
    folder = _folder(t, "audit")
    e.export_audit(t.visits.groupBy("dx").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("status")).alias("status"), F.concat(F.lit('he said "'), F.first("dx"), F.lit('", twice')).alias("note")), folder)
    return t.spark.read.option("header", True).option("escape", '"').csv(folder)


@query("s12_metric_report", """SELECT concat('{"labels":[', string_agg(concat('{"label":"', label, '","n":', n, '}'), ',' ORDER BY label), '],"types":[', (SELECT string_agg(concat('{"type":"', type, '","n":', n, '}'), ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM edges GROUP BY 1)), ']}') AS report FROM (SELECT label, count(*) AS n FROM nodes GROUP BY 1)""")
def s12_report(t):
    return e.metric_report({"labels": t.nodes.groupBy("label").agg(F.count("*").alias("n")), "types": t.edges.groupBy("type").agg(F.count("*").alias("n"))})


@query("t01_merge_concepts", """SELECT concat('part:', p_partkey) AS uri, p_name AS label, CASE WHEN p_partkey % 2 = 0 THEN 'OLD' ELSE 'NEW' END AS source_ontology, CASE WHEN p_partkey % 3 = 0 THEN 'c3' WHEN p_partkey % 2 = 0 THEN 'c2' END AS code, p_partkey % 2 = 1 AS created FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def t01_merge(t):
    row = lambda rows, source, code: rows.select(F.concat(F.lit("part:"), "p_partkey").alias("uri"), F.expr(code).alias("code"), F.col("p_name").alias("label"), F.lit(source).alias("source_ontology"), F.lit(None).cast("string").alias("purl"))
    known = row(t.part.where("p_partkey % 2 = 0"), "OLD", "CASE WHEN p_partkey % 3 <> 0 THEN 'c2' END")
    new = row(t.part.where("p_partkey % 3 = 0"), "NEW", "'c3'")
    return o.merge_concepts(known, new.unionByName(new)).select("uri", "label", "source_ontology", "code", "created")


@query("t07_gene_edges", """SELECT 'ENCODES' AS type, 'ro:RO_0002205' AS uri, count(DISTINCT (fid, analyte)) AS n, count(DISTINCT analyte) AS genes FROM facts WHERE analyte IN ('TAU', 'PTAU', 'NFL') UNION ALL SELECT 'PARTICIPATES_IN', 'ro:RO_0000056', count(*), count(DISTINCT analyte) FROM (SELECT DISTINCT analyte, part FROM facts WHERE analyte IN ('TAU', 'PTAU', 'NFL'))
    UNION ALL SELECT 'SAME_AS', 'skos:exactMatch', count(*), 3 FROM part WHERE p_partkey % 4 < 3""")  # fmt: skip
def t07_edges(t):
    genes = t.spark.createDataFrame([("TAU", "gene:1"), ("PTAU", "gene:2"), ("NFL", "gene:3"), ("NFL", "gene:9")], "symbol string, id string")
    annotations = t.facts.select(F.col("analyte").alias("symbol"), F.concat(F.lit("go:"), "part").alias("term"))
    markers = t.facts.select(F.concat(F.lit("m:"), "fid").alias("id"), F.col("analyte").alias("gene"))
    external = t.part.select(F.concat(F.lit("x:"), "p_partkey").alias("id"), F.lit("Gene").alias("kind"), F.expr("array('TAU', 'PTAU', 'NFL', 'none')[p_partkey % 4]").alias("label"))
    edges = o.gene_layer(genes, annotations, markers, external)
    return edges.groupBy("type", "uri").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("type") == "PARTICIPATES_IN", F.col("src")).otherwise(F.col("dst"))).alias("genes"))


@query("t08_bridge_of_parts", """WITH c AS (SELECT DISTINCT p_name AS label FROM part), x AS (SELECT p_partkey, p_name FROM part) SELECT p_partkey AS src, concat('rule:', p_partkey % 5) AS dst, 'curated' AS method FROM x WHERE p_partkey % 4 = 0 AND p_partkey % 5 < 3
    UNION ALL SELECT p_partkey, concat('label:', p_name), 'label' FROM x WHERE p_partkey % 4 <> 0 AND contains(p_name, 'red')""")  # fmt: skip
def t08_parts(t):
    external = t.part.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("label"))
    by_label = t.part.where("contains(p_name, 'red')").select(F.concat(F.lit("label:"), "p_name").alias("uri"), F.col("p_name").alias("label")).distinct()
    concepts = by_label.unionByName(t.spark.createDataFrame([(f"rule:{i}", f"concept {i}") for i in range(3)], "uri string, label string"))
    rules = t.part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.expr("concat('rule:', p_partkey % 5)").alias("uri"), F.lit("curated").alias("method"))
    return o.external_bridge(external, concepts, rules)


@query("t08_typed_relations", "SELECT p_partkey AS src, CASE p_size % 4 WHEN 0 THEN 'ro:RO_0002606' WHEN 1 THEN 'ro:RO_0002451' WHEN 2 THEN 'given' ELSE 'skos:related' END AS uri FROM part")
def t08_relations(t):
    rows = t.part.select(F.col("p_partkey").alias("src"), F.expr("array('treats', 'Associated_With', 'PRESENTS', 'other')[p_size % 4]").alias("kind"), F.col("p_partkey").alias("dst"), F.expr("CASE WHEN p_size % 4 = 2 THEN 'given' END").alias("uri"))
    return o.typed_relations(rows).select("src", "uri")


_CONSENSUS = f"e AS ({_ALG}), p AS (SELECT least(source, target) AS x, greatest(source, target) AS y, count(DISTINCT algorithm) AS k, count(*) FILTER (WHERE source < target) AS fx, count(*) FILTER (WHERE source > target) AS fy, bool_or(direction = 'directed') AS d FROM e GROUP BY ALL), c AS (SELECT CASE WHEN d AND fy > fx THEN y ELSE x END AS source, CASE WHEN d AND fy > fx THEN x ELSE y END AS target, k, d FROM p)"


@query("x07_all_edges", f"WITH {_CONSENSUS} SELECT CASE source WHEN 'TAU' THEN 'loinc:1' WHEN 'AGE' THEN 'loinc:2' ELSE concat('cohort:', source) END AS src, 'CAUSES' AS type, CASE target WHEN 'TAU' THEN 'loinc:1' WHEN 'AGE' THEN 'loinc:2' ELSE concat('cohort:', target) END AS dst, k::int AS algorithms FROM c UNION ALL SELECT 'variable:TAU', 'MAPS_TO', 'loinc:1', NULL WHERE EXISTS (SELECT 1 FROM c WHERE 'TAU' IN (source, target))")
def x07_all(t):
    """All consensus edges; AGE's concept isn't in the graph, so it maps to nothing."""
    concepts = {"TAU": ("loinc:1", "Tau", "LOINC"), "AGE": ("loinc:2", "Age", "LOINC")}
    known = t.spark.createDataFrame([("loinc:1",)], "uri string")
    return o.embed_causes(x.consensus(_algorithms(t), 1), concepts, known).select("src", "type", "dst", F.size("algorithms").alias("algorithms"))


@query("x08_either_way", f"WITH e AS ({_ALG}), f AS (SELECT DISTINCT source, target FROM e WHERE algorithm IN ('alg0', 'alg3') UNION SELECT target, source FROM e WHERE algorithm IN ('alg0', 'alg3') AND direction = 'undirected'), g AS (SELECT DISTINCT source, target FROM e WHERE algorithm = 'alg1'), s AS (SELECT (SELECT count(*) FROM f SEMI JOIN g USING (source, target)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM g) AS ng) SELECT round(coalesce(tp / nullif(nf, 0), 0), 6)::double AS precision, round(coalesce(tp / nullif(ng, 0), 0), 6)::double AS recall, round(coalesce(2 * tp / nullif(nf + ng, 0), 0), 6)::double AS f1, nf + ng - 2 * tp AS shd, nf AS n_found, ng AS n_true FROM s")
def x08_either(t):
    edges = _algorithms(t)
    return x.edge_scores_either_way(edges.where("algorithm IN ('alg0', 'alg3')"), edges.where("algorithm = 'alg1'"))


@query("x12_totals", f"WITH {_CONSENSUS} SELECT count(*) AS total, count(*) FILTER (WHERE d) AS validated, round(coalesce(100.0 * count(*) FILTER (WHERE d) / nullif(count(*), 0), 0), 6)::double AS validation_rate FROM c")
def x12_totals(t):
    return o.causal_totals(x.consensus(_algorithms(t), 1).withColumn("validated", F.col("directed")))


@query("x12_by_algorithm", f"SELECT algorithm, count(DISTINCT (least(source, target), greatest(source, target))) AS n FROM ({_ALG}) GROUP BY 1")
def x12_by(t):
    return o.edges_by_algorithm(x.consensus(_algorithms(t), 1))


@query("x04_tests", """WITH c AS (SELECT count(*) AS n, corr(age, edu) AS ab, corr(age, acctbal) AS ac, corr(edu, acctbal) AS bc FROM patients), r AS (SELECT 'age' AS a, 'edu' AS b, NULL AS given, ab AS r, n - 3 AS d FROM c UNION ALL SELECT 'age', 'acctbal', NULL, ac, n - 3 FROM c UNION ALL SELECT 'edu', 'acctbal', NULL, bc, n - 3 FROM c UNION ALL SELECT 'age', 'edu', 'acctbal', (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), n - 4 FROM c
    UNION ALL SELECT 'age', 'acctbal', 'edu', (ac - ab * bc) / sqrt((1 - ab * ab) * (1 - bc * bc)), n - 4 FROM c UNION ALL SELECT 'edu', 'acctbal', 'age', (bc - ab * ac) / sqrt((1 - ab * ab) * (1 - ac * ac)), n - 4 FROM c), z AS (SELECT *, abs(0.5 * ln((1 + r) / (1 - r)) * sqrt(d)) AS z FROM r)
    SELECT a, b, given, round(r, 6) AS r, z > 1.959963984540054 AS dependent FROM z""")  # fmt: skip
def x04_tests(t):
    """All pairs of three variables, of order 0 and 1, with the test's decision at 5 percent."""
    rows = x.partial_correlations(t.patients, ["age", "edu", "acctbal"])
    return rows.select("a", "b", "given", "r", (~F.col("independent") & (F.col("p") <= 0.05)).alias("dependent"))


@query("x10_parents_of_treatment", """WITH r AS (SELECT dx, mmse::double AS y, months::double AS t, price / 100000 AS a, edu::double AS b FROM visits v JOIN patients p ON v.pid = p.pid), s AS (SELECT dx, count(*) AS n, covar_pop(y, t) AS yt, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, var_pop(t) AS tt, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(t, a) AS ta, covar_pop(t, b) AS tb, covar_pop(a, b) AS ab FROM r GROUP BY 1)
    SELECT dx, n, round((yt * (aa * bb - ab * ab) - ta * (ya * bb - ab * yb) + tb * (ya * ab - aa * yb)) / (tt * (aa * bb - ab * ab) - ta * (ta * bb - ab * tb) + tb * (ta * ab - aa * tb)), 6) AS effect FROM s""")  # fmt: skip
def x10_parents(t):
    """The treatment's two parents in the edge table are adjusted for; what follows from it is not."""
    edges = t.spark.createDataFrame([("price", "months"), ("edu", "months"), ("months", "mmse"), ("mmse", "dx"), ("price", "mmse")], "source string, target string")
    rows = t.visits.join(t.patients.select("pid", "edu"), "pid").select("dx", "mmse", "months", F.expr("price / 100000").alias("price"), "edu")
    return x.backdoor_effect(rows, edges, "months", "mmse", "dx")


@query("m07_twelve_keys", """SELECT * FROM (SELECT 'patient' AS key, count(*) AS n, 0::bigint AS nulls, count(*) - count(DISTINCT pid) AS repeated FROM patients UNION ALL SELECT 'patient_name', count(*), 0, count(*) - count(DISTINCT name) FROM patients UNION ALL SELECT 'visit', count(*), 0, count(*) - count(DISTINCT vid) FROM visits UNION ALL SELECT 'visit_month', count(*), 0, count(*) - count(DISTINCT (pid, months)) FROM visits UNION ALL SELECT 'fact', count(*), 0, count(*) - count(DISTINCT fid) FROM facts
    UNION ALL SELECT 'fact_line', count(*), 0, count(*) - count(DISTINCT (vid, line)) FROM facts UNION ALL SELECT 'fact_part', count(*), 0, count(*) - count(DISTINCT (vid, part)) FROM facts UNION ALL SELECT 'node', count(*), 0, count(*) - count(DISTINCT id) FROM nodes UNION ALL SELECT 'node_uri', count(*), count(*) - count(uri), count(uri) - count(DISTINCT uri) FROM nodes UNION ALL SELECT 'edge', count(*), 0, count(*) - count(DISTINCT (src, type, dst)) FROM edges
    UNION ALL SELECT 'supplier', count(*), 0, count(*) - count(DISTINCT s_suppkey) FROM supplier UNION ALL SELECT 'genotype', count(*), count(*) - count(genotype), count(genotype) - count(DISTINCT genotype) FROM patients)""")  # fmt: skip
def m07_keys(t):
    keys = {
        "patient": (t.patients, ["pid"]), "patient_name": (t.patients, ["name"]), "visit": (t.visits, ["vid"]), "visit_month": (t.visits, ["pid", "months"]), "fact": (t.facts_by_visit, ["fid"]), "fact_line": (t.facts_by_visit, ["vid", "line"]), "fact_part": (t.facts_by_visit, ["vid", "part"]),
        "node": (t.nodes, ["id"]), "node_uri": (t.nodes, ["uri"]), "edge": (t.edges, ["src", "type", "dst"]), "supplier": (t.supplier, ["s_suppkey"]), "genotype": (t.patients, ["genotype"]),
    }
    return o.keys_hold(keys).drop("holds")


@query("m07_codes_by_label", "SELECT label, count(*) AS total, count(uri) AS with_code, round(count(uri) / count(*), 6) AS coverage, count(uri) / count(*) >= 0.4 AS passed, false AS hard_fail FROM nodes WHERE label IN ('Patient', 'Visit', 'Supplier') AND (label <> 'Visit' OR name = 'F') GROUP BY 1 UNION ALL SELECT 'Gene', 0, 0, 0.0::double, false, true")
def m07_codes(t):
    return o.codes_by_label(t.nodes, [("Patient", "uri", 0.4, None), ("Visit", "uri", 0.4, "name = 'F'"), ("Supplier", "uri", 0.4, None), ("Gene", "uri", 0.4, None)])


@query("m07_forbidden", "SELECT count(*) AS violations, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT DISTINCT id FROM nodes WHERE starts_with(id, 'V:1') ORDER BY id LIMIT 10)) AS sample FROM nodes WHERE starts_with(id, 'V:1')")
def m07_forbidden(t):
    return o.forbidden_prefix(t.nodes, "id", "V:1").withColumn("sample", F.array_join("sample", ","))


@query("g08_two_hops", "WITH e AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) SELECT x.a AS id, y.b AS other, count(*) AS ways FROM e x JOIN e y ON x.b = y.a WHERE x.a LIKE 'S:%' AND y.b LIKE 'R:%' AND x.a <> y.b GROUP BY ALL")
def g08_two(t):
    """The regions two hops from each supplier."""
    from strandline.operators.graph import ends

    hop = ends(t.edges).select("id", "other").distinct()
    one = hop.where(F.col("id").startswith("S:"))
    two = one.withColumnRenamed("other", "_mid").join(hop.select(F.col("id").alias("_mid"), F.col("other").alias("far")), "_mid")
    return two.where(F.col("far").startswith("R:") & (F.col("id") != F.col("far"))).groupBy("id", F.col("far").alias("other")).agg(F.count("*").alias("ways"))


@query("g09_three_deep", "WITH h AS (SELECT 'P:' || c_custkey AS a, 'N:' || c_nationkey AS b FROM customer UNION ALL SELECT 'V:' || o_orderkey, 'P:' || o_custkey FROM orders UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation) SELECT ancestor, depth, count(*) AS n FROM (SELECT a AS descendant, b AS ancestor, 1::int AS depth FROM h UNION SELECT x.a, y.b, 2 FROM h x JOIN h y ON x.b = y.a UNION SELECT x.a, z.b, 3 FROM h x JOIN h y ON x.b = y.a JOIN h z ON y.b = z.a) WHERE starts_with(ancestor, 'R:') OR starts_with(ancestor, 'N:') GROUP BY ALL")
def g09_three(t):
    """A hierarchy of visits, patients, nations and regions: everything below each nation and region, with its depth."""
    from strandline.operators.graph import closure

    edge = lambda rows, a, i, b, j: rows.select(F.concat(F.lit(a), i).alias("src"), F.lit("PART_OF").alias("type"), F.concat(F.lit(b), j).alias("dst"))
    edges = edge(t.customer, "P:", "c_custkey", "N:", "c_nationkey").unionByName(edge(t.orders, "V:", "o_orderkey", "P:", "o_custkey")).unionByName(edge(t.nation, "N:", "n_nationkey", "R:", "n_regionkey"))
    return closure(edges, "PART_OF", 3).where(F.col("ancestor").startswith("R:") | F.col("ancestor").startswith("N:")).groupBy("ancestor", "depth").agg(F.count("*").alias("n"))
