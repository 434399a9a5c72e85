"""Queries over ontology grounding, quality gates, metrics and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.clean import uri_namespace
from strandline.operators import graph as g
from strandline.operators import quality as q
from strandline.operators import relational as r
from strandline.plans.cohort import query

_NS = "CASE WHEN uri LIKE 'http://purl.obolibrary.org/obo/RO%' THEN 'RO' WHEN uri LIKE 'https://w3id.org/biolink/%' THEN 'Biolink' WHEN uri LIKE 'http://www.w3.org/2000/01/rdf-schema#%' THEN 'RDFS' WHEN uri LIKE 'http://purl%' THEN 'OBO' WHEN uri IS NOT NULL THEN 'other' END"


def _concepts(t):
    return t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("uri"), F.col("n_name").alias("label"))


@query("t01_concepts", "SELECT concat('nation:', n_nationkey) AS uri, n_name AS label, 'NATION' AS source_ontology FROM nation")
def t01(t):
    return _concepts(t).withColumn("source_ontology", F.lit("NATION"))


@query("t02_hierarchy", "SELECT concat('nation:', n_nationkey) AS child, concat('region:', n_regionkey) AS parent FROM nation WHERE n_regionkey <> 4")
def t02(t):
    concepts = _concepts(t).unionByName(t.region.where("r_regionkey <> 4").select(F.concat(F.lit("region:"), "r_regionkey").alias("uri"), F.col("r_name").alias("label")))
    return q.hierarchy(t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("child"), F.concat(F.lit("region:"), "n_regionkey").alias("parent")), concepts)


@query("t03_maps_to", "SELECT pid AS src, 'MAPS_TO' AS type, concat('nation:', nation) AS dst FROM patients")
def t03(t):
    return q.maps_to(t.patients, "pid", "nation", "nation:", _concepts(t))


@query("t04_classified_as", "SELECT DISTINCT dx AS src, 'CLASSIFIED_AS' AS type, concat('icd:', CASE dx WHEN 'AD' THEN 'G30' WHEN 'MCI' THEN 'G31' END) AS dst FROM visits WHERE dx IN ('AD', 'MCI')")
def t04(t):
    codes = t.spark.createDataFrame([("AD", "G30"), ("MCI", "G31")], "dx string, code string")
    icd = t.spark.createDataFrame([("icd:G30",), ("icd:G31",), ("icd:G3",)], "uri string")
    return q.maps_to(t.visits.select("dx").distinct().join(F.broadcast(codes), "dx"), "dx", "code", "icd:", icd, "CLASSIFIED_AS")


@query("t05_enrich_properties", "SELECT count(*) AS total, count(*) FILTER (WHERE dx IN ('CN', 'AD')) AS coded, round(100 * count(*) FILTER (WHERE dx IN ('CN', 'AD')) / count(*), 4) AS pct FROM visits")
def t05(t):
    codes = t.spark.createDataFrame([("CN", "17621005"), ("AD", "26929004")], "dx string, snomed string")
    rows = t.visits.join(F.broadcast(codes), "dx", "left")
    return rows.agg(F.count("*").alias("total"), F.count("snomed").alias("coded")).withColumn("pct", F.round(100 * F.col("coded") / F.col("total"), 4))


@query("t06_edge_uris", "SELECT type, count(*) AS n, count(coalesce(uri, CASE type WHEN 'HAS_VISIT' THEN 'ro:1' END)) AS with_uri FROM edges GROUP BY 1")
def t06(t):
    rules = t.spark.createDataFrame([("HAS_VISIT", "ro:1")], "type string, uri string")
    return q.fill_uris(t.edges, rules).groupBy("type").agg(F.count("*").alias("n"), F.count("uri").alias("with_uri"))


@query("t07_gene_layer", "SELECT gene, term, count(*) AS patients FROM patients JOIN (VALUES ('E4', 'APOE', 'GO:1'), ('E3', 'APOE', 'GO:2')) g(allele, gene, term) ON contains(genotype, allele) GROUP BY ALL")
def t07(t):
    genes = t.spark.createDataFrame([("E4", "APOE", "GO:1"), ("E3", "APOE", "GO:2")], "allele string, gene string, term string")
    alleles = t.patients.select("pid", F.explode(F.array_distinct(F.split("genotype", "/"))).alias("allele"))
    return alleles.join(F.broadcast(genes), "allele").groupBy("gene", "term").agg(F.count("*").alias("patients"))


@query("t08_external_bridge", "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN 'rule' ELSE 'label' END AS method FROM nation WHERE n_nationkey < 10")
def t08(t):
    rules = t.spark.createDataFrame([(i, f"ext:{i}") for i in range(5)], "id int, ext string")
    labels = t.nation.where("n_nationkey < 10").select(F.lower("n_name").alias("label"), F.concat(F.lit("ext:"), "n_nationkey").alias("ext"))
    base = t.nation.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("label"))
    by_rule = base.join(F.broadcast(rules), "id").select("id", F.lit("rule").alias("method"))
    return by_rule.unionByName(base.join(by_rule, "id", "left_anti").join(labels, "label").select("id", F.lit("label").alias("method")))


@query("t09_orphan_concepts", "SELECT concat('N:', n_nationkey) AS id FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 10 <> 9 AND c_acctbal > 9900)")
def t09(t):
    used = t.customer.where("c_custkey % 10 <> 9 and c_acctbal > 9900").select(F.concat(F.lit("N:"), "c_nationkey").alias("id"))
    return r.without(t.nation.select(F.concat(F.lit("N:"), "n_nationkey").alias("id")), used, "id")


@query("t10_value_patterns", "SELECT target, count(*) AS n FROM visits JOIN (VALUES ('MCI', 'DOID:1'), ('SMC', 'DOID:1'), ('AD', 'DOID:2')) v(k, target) ON dx = k GROUP BY 1")
def t10(t):
    rules = t.spark.createDataFrame([("MCI|SMC", "DOID:1"), ("AD", "DOID:2")], "pattern string, target string")
    return q.value_pattern_match(t.visits, "dx", rules).groupBy("target").agg(F.count("*").alias("n"))


@query("m01_semantic_density", "SELECT label, count(*) AS total, count(uri) AS with_uri, round(count(uri) / count(*), 6) AS share FROM nodes GROUP BY 1 UNION ALL SELECT type, count(*), count(uri), round(count(uri) / count(*), 6) FROM edges GROUP BY 1 UNION ALL SELECT 'all nodes', count(*), count(uri), round(count(uri) / count(*), 6) FROM nodes UNION ALL SELECT 'all edges', count(*), count(uri), round(count(uri) / count(*), 6) FROM edges")
def m01(t):
    every = [q.density_by(rows.select(F.lit(f"all {name}").alias("label"), "uri"), "label") for name, rows in (("nodes", t.nodes), ("edges", t.edges))]
    return q.density_by(t.nodes, "label").unionByName(q.density_by(t.edges, "type").withColumnRenamed("type", "label")).unionByName(every[0]).unionByName(every[1])


@query("m02_tbox_abox", "SELECT 'N' AS source, (SELECT count(*) FROM nation) AS concepts, count(DISTINCT src) AS grounded, round(count(DISTINCT src) / (SELECT count(*) FROM nation), 6) AS ratio FROM edges WHERE type IN ('LIVES_IN', 'BASED_IN')")
def m02(t):
    used = t.edges.where("type in ('LIVES_IN', 'BASED_IN')").groupBy(F.substring("dst", 1, 1).alias("source")).agg(F.count_distinct("src").alias("grounded"))
    concepts = t.nodes.where("label = 'Nation'").groupBy(F.substring("id", 1, 1).alias("source")).agg(F.count("*").alias("concepts"))
    return concepts.join(used, "source").withColumn("ratio", F.round(F.col("grounded") / F.col("concepts"), 6))


@query("m03_duplicity", "SELECT 'facts' AS name, count(*) AS total, count(DISTINCT fid) AS distinct_keys, count(*) - count(DISTINCT fid) AS extra FROM facts UNION ALL SELECT 'visits', count(*), count(DISTINCT (pid, months)), count(*) - count(DISTINCT (pid, months)) FROM visits")
def m03(t):
    return q.duplicity({"facts": (t.facts, ["fid"]), "visits": (t.visits, ["pid", "months"])})


@query("m05_source_contribution", f"SELECT namespace, n, round(100 * n / sum(n) OVER (), 4) AS pct FROM (SELECT {_NS} AS namespace, count(*) AS n FROM edges WHERE uri IS NOT NULL GROUP BY 1)")
def m05(t):
    return q.source_contribution(t.edges)


@query("m06_external_alignment", "SELECT n_regionkey AS category, count(*) AS total, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS strong, round(count(*) FILTER (WHERE n_nationkey % 2 = 0) / count(*), 6) AS share FROM nation GROUP BY 1")
def m06(t):
    linked = t.nation.where("n_nationkey % 2 = 0").select("n_nationkey").withColumn("hit", F.lit(1))
    rows = t.nation.join(linked, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("category")).agg(F.count("*").alias("total"), F.count("hit").alias("strong"))
    return rows.withColumn("share", F.round(F.col("strong") / F.col("total"), 6))


@query("m07_validity_gate", """SELECT 'A1' AS id, round(count(DISTINCT id) / count(*), 6)::double AS measured, count(DISTINCT id) = count(*) AS passed, count(DISTINCT id) < count(*) AS hard_fail FROM nodes UNION ALL SELECT 'A2', round(count(uri) / count(*), 6), count(uri) / count(*) >= 0.5, false FROM nodes
    UNION ALL SELECT 'A4', round(count(uri) / count(*), 6), count(uri) / count(*) >= 0.99, count(uri) / count(*) < 0.99 FROM edges UNION ALL SELECT 'A7', 1.0::double, true, false""")  # fmt: skip
def m07(t):
    share = lambda df: df.agg((F.count("uri") / F.count("*")).alias("measured"))
    return q.gate([
        ("A1", t.nodes.agg((F.count_distinct("id") / F.count("*")).alias("measured")), 1.0, True), ("A2", share(t.nodes), 0.5, False), ("A4", share(t.edges), 0.99, True),
        ("A7", t.nodes.agg((1 - F.count_if(F.col("id").startswith("381_S_"))).alias("measured")), 1.0, True),
    ])


@query("m07_sources_types_concepts", """WITH c AS (SELECT * FROM nodes WHERE label IN ('Nation', 'Region')), k AS (SELECT type, count(uri) / count(*) AS s FROM edges WHERE type <> 'IS_A' GROUP BY 1),
    m AS (SELECT 'A3' AS id, ((count(*) FILTER (WHERE label = 'Nation') > 0)::int + (count(*) FILTER (WHERE label = 'Region') > 0)::int + (count(*) FILTER (WHERE label = 'Gene') > 0)::int + (count(*) FILTER (WHERE label = 'Nation') BETWEEN 20 AND 30)::int) / 4 AS v, 1.0 AS least FROM c
    UNION ALL SELECT 'A5', count(*) FILTER (WHERE s >= 0.6) / count(*), 0.95 FROM k
    UNION ALL SELECT 'A6', count(*) FILTER (WHERE id IN (SELECT dst FROM edges WHERE type IN ('IS_A', 'BASED_IN')) OR uri = 'http://purl.obolibrary.org/obo/N_3') / count(*), 0.5 FROM c)
    SELECT id, round(v, 6)::double AS measured, v >= least AS passed, id = 'A3' AND v < least AS hard_fail FROM m""")  # fmt: skip
def m07b(t):
    concepts = t.nodes.where("label in ('Nation', 'Region')")
    return q.gate([
        ("A3", q.sources_present(concepts, "label", ["NATION", "Region", "Gene"], {"nation": (20, 30)}), 1.0, True), ("A5", q.types_covered(t.edges, 0.6, ["is_a"]), 0.95, False),
        ("A6", q.concepts_reached(concepts, t.edges, ["IS_A", "BASED_IN"], ["http://purl.obolibrary.org/obo/N_3"]), 0.5, False),
    ])


@query("m08_fair_score", "SELECT 'F' AS dimension, CASE WHEN n >= 0.9 THEN 1.0 WHEN n >= 0.4 THEN 0.5 ELSE 0.0 END::double AS score FROM (SELECT count(uri) / count(*) AS n FROM edges) UNION ALL SELECT 'I', 0.0::double UNION ALL SELECT 'all', CASE WHEN n >= 0.9 THEN 1.0 WHEN n >= 0.4 THEN 0.5 ELSE 0.0 END::double / 2 FROM (SELECT count(uri) / count(*) AS n FROM edges)")
def m08(t):
    rubric = t.spark.createDataFrame([("F1", "F", 0.4, 0.9), ("I1", "I", 0.5, 1.0)], "id string, dimension string, partial double, full double")
    return q.fair_score(t.edges.agg(F.lit("F1").alias("id"), (F.count("uri") / F.count("*")).alias("measured")), rubric)


@query("m09_ablation", f"SELECT 'none' AS scenario, count(*) FILTER (WHERE uri IS NULL) AS kept, round(count(*) FILTER (WHERE uri IS NULL) / count(*), 6) AS share FROM edges UNION ALL SELECT 'ro', count(*) FILTER (WHERE uri IS NULL OR {_NS} = 'RO'), round(count(*) FILTER (WHERE uri IS NULL OR {_NS} = 'RO') / count(*), 6) FROM edges")
def m09(t):
    return q.ablation(t.edges, {"none": [], "ro": ["RO"]})


@query("m11_step_audit", "SELECT step, n, n - coalesce(lag(n) OVER (ORDER BY step), 0) AS d_n FROM (SELECT year(vdate)::int AS step, count(*) AS n FROM visits GROUP BY 1)")
def m11(t):
    return q.step_deltas(t.visits.groupBy(F.year("vdate").alias("step")).agg(F.count("*").alias("n")), "step", "n")


@query("m12_state_equivalence", "SELECT coalesce(a.dx, b.dx) AS dx, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT dx, count(*) n FROM visits GROUP BY 1) a FULL JOIN (SELECT dx, count(*) n FROM visits WHERE dx <> 'AD' GROUP BY 1) b ON a.dx = b.dx WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)")
def m12(t):
    n = lambda rows: rows.groupBy("dx").agg(F.count("*").alias("n"))
    return q.equivalent(n(t.visits), n(t.visits.where("dx <> 'AD'")), "dx", "n")


@query("m13_step_rollback", "SELECT type, count(*) AS n FROM edges WHERE type <> 'LIVES_IN' GROUP BY 1")
def m13(t):
    added = t.edges.where("type = 'LIVES_IN'").select("src", "type", "dst")
    return t.edges.join(added, ["src", "type", "dst"], "left_anti").groupBy("type").agg(F.count("*").alias("n"))


@query("m14_label_audit", "SELECT concat('part:', p_partkey) AS uri, CASE WHEN p_partkey % 7 = 0 THEN 'unresolved' WHEN p_partkey % 5 = 0 THEN 'mismatch' ELSE 'match' END AS status FROM part")
def m14(t):
    uri = F.concat(F.lit("part:"), "p_partkey").alias("uri")
    reference = t.part.where("p_partkey % 7 > 0").select(uri, F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE upper(p_name) END").alias("label"))
    return q.label_audit(t.part.select(uri, F.col("p_name").alias("label")), reference)


@query("m15_ontology_coverage", "SELECT label, count(*) AS total, count(*) FILTER (WHERE id IN (SELECT src FROM edges WHERE type IN ('LIVES_IN', 'BASED_IN', 'IS_A'))) AS mapped FROM nodes GROUP BY 1")
def m15(t):
    mapped = t.edges.where("type in ('LIVES_IN', 'BASED_IN', 'IS_A')").select(F.col("src").alias("id")).distinct().withColumn("m", F.lit(1))
    return t.nodes.join(mapped, "id", "left").groupBy("label").agg(F.count("*").alias("total"), F.count("m").alias("mapped"))


@query("m16_quality_report", "SELECT 'visits_without_facts' AS issue, count(*) AS n FROM visits WHERE vid NOT IN (SELECT vid FROM facts) UNION ALL SELECT 'patients_without_visits', count(*) FROM patients WHERE pid NOT IN (SELECT pid FROM visits)")
def m16(t):
    one = lambda rows, name: rows.agg(F.lit(name).alias("issue"), F.count("*").alias("n"))
    return one(r.without(t.visits, t.facts, "vid"), "visits_without_facts").unionByName(one(r.without(t.patients, t.visits, "pid"), "patients_without_visits"))


@query("m19_family_integrity", "SELECT count(*) AS one_way FROM patients WHERE pid + 1 < (SELECT count(*) FROM patients)")
def m19(t):
    n = t.patients.count()
    members = t.patients.where(f"pid + 1 < {n}").select(F.col("pid").alias("src"), F.lit("HAS_PARENT").alias("type"), F.expr("pid + 1").alias("dst"))
    return g.missing_inverses(members, {"HAS_PARENT": "HAS_CHILD"}).agg(F.count("*").alias("one_way"))


@query("m20_processing_status", "SELECT status, count(*) AS n, round(avg((price > 100000)::int), 6) AS success_rate FROM visits GROUP BY 1")
def m20(t):
    return t.visits.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(F.expr("int(price > 100000)")), 6).alias("success_rate"))


@query("m21_quality_distribution", "SELECT CASE WHEN mmse / 30 >= 0.9 THEN 'excellent' WHEN mmse / 30 >= 0.7 THEN 'good' WHEN mmse / 30 >= 0.5 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n, round(avg(mmse / 30), 6) AS mean FROM visits GROUP BY 1")
def m21(t):
    return q.quality_bands(t.visits, F.col("mmse") / 30)


@query("m22_validation_statistics", "SELECT status, count(*) AS n, count(*) FILTER (WHERE mmse < 5) AS errors, count(*) FILTER (WHERE mmse >= 5 AND price < 50000) AS warned, round(count(*) FILTER (WHERE mmse >= 5) / count(*), 6) AS pass_rate FROM visits GROUP BY 1")
def m22(t):
    errors, warnings = (F.filter(F.array(F.when(F.expr(c), w)), lambda x: x.isNotNull()) for c, w in (("mmse < 5", "range"), ("price < 50000", "low")))
    rows = t.visits.select("status", F.size(errors).alias("e"), F.size(warnings).alias("w"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("e") > 0).alias("errors"), F.count_if((F.col("e") == 0) & (F.col("w") > 0)).alias("warned"), F.round(F.count_if(F.col("e") == 0) / F.count("*"), 6).alias("pass_rate"))


@query("m23_dataset_statistics", "SELECT segment, genotype, count(*) AS n, round(avg(age), 6) AS age, coalesce(sum(k), 0)::bigint AS modalities FROM patients p LEFT JOIN (SELECT pid, count(DISTINCT analyte) AS k FROM facts GROUP BY 1) f ON p.pid = f.pid GROUP BY ALL")
def m23(t):
    k = t.facts.groupBy("pid").agg(F.count_distinct("analyte").alias("k"))
    return t.patients.join(k, "pid", "left").groupBy("segment", "genotype").agg(F.count("*").alias("n"), F.round(F.avg("age"), 6).alias("age"), F.coalesce(F.sum("k"), F.lit(0)).alias("modalities"))


@query("r01_filtered_search", "SELECT vid FROM visits WHERE dx = 'AD' AND mmse BETWEEN 10 AND 20 AND vdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def r01(t):
    conditions = [F.col("dx") == "AD", F.col("mmse").between(10, 20), F.col("vdate").between(F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date"))]
    return t.visits.where(r.all_of(conditions)).select("vid")


@query("r02_fuzzy_rank", "SELECT p_partkey, (list_bool_or([levenshtein(w, 'small') <= 1 FOR w IN string_split(lower(p_name), ' ')])::int * 2.0 + list_bool_or([levenshtein(w, 'widgets') <= 2 FOR w IN string_split(lower(p_name), ' ')])::int * 2.0)::double AS score FROM part WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 30")
def r02(t):
    return q.fuzzy_rank(t.part, "p_partkey", {"p_name": 2.0}, "small widgets", 30)


@query("r03_combined_rank", "SELECT kind, id, score FROM (SELECT 'patient' AS kind, pid::varchar AS id, round(acctbal / 10000 * 1.0, 6) AS score FROM patients UNION ALL SELECT 'visit', vid::varchar, round(price / 500000 * 0.8, 6) FROM visits) ORDER BY score DESC, kind, id LIMIT 40")
def r03(t):
    return q.combined_rank({"patient": (t.patients.selectExpr("pid as id", "acctbal / 10000 as score"), 1.0), "visit": (t.visits.selectExpr("vid as id", "price / 500000 as score"), 0.8)}, 40)


@query("r04_facets", "SELECT 'dx' AS field, dx AS value, count(*) AS n FROM visits GROUP BY dx UNION ALL SELECT 'status', status, count(*) FROM visits GROUP BY status")
def r04(t):
    return q.facets(t.visits, "dx", "status")


@query("r05_suggestions", "SELECT p_name FROM (SELECT DISTINCT p_name FROM part) WHERE contains(lower(p_name), 're') ORDER BY NOT starts_with(lower(p_name), 're'), p_name LIMIT 5")
def r05(t):
    return q.suggestions(t.part, "p_name", "re")


@query("r06_image_lookup", "SELECT doc_id, md5(text) AS hash FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 100 = 0)")
def r06(t):
    hashed = t.documents.select("doc_id", F.md5("text").alias("hash"))
    return hashed.join(hashed.where("doc_id % 100 = 0").select("hash").distinct(), "hash", "left_semi").select("doc_id", "hash")


@query("m18_step_durations", "SELECT event_type AS step, count(*) AS runs, round(sum(value), 3) AS seconds FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def m18(t):
    line = F.expr("CASE WHEN event_id % 2 = 0 THEN concat('12:00 INFO step ', event_type, ' finished in ', cast(value as decimal(18, 4)), ' s') ELSE concat('step ', event_type, ' started') END")
    return q.step_durations(t.events.select(line.alias("value")))
