"""End-to-end questions over the cohort: compositions of the operators, named by SURVEY section 5.1."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import clean
from strandline.operators import graph as g
from strandline.operators import relational as r
from strandline.plans.cohort import query


def _n(rows, *by):
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


@query("q1_1_node_types", "SELECT label, count(*) AS n FROM nodes GROUP BY 1")
def q1_1(t):
    return _n(t.nodes, "label")


@query("q1_2_relationship_types", "SELECT type, count(*) AS n FROM edges GROUP BY 1")
def q1_2(t):
    return _n(t.edges, "type")


@query("q1_3_graph_size", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes), 6) AS edges_a_node")
def q1_3(t):
    return t.nodes.agg(F.count("*").alias("nodes")).crossJoin(t.edges.agg(F.count("*").alias("edges"))).withColumn("edges_a_node", F.round(F.col("edges") / F.col("nodes"), 6))


@query("q1_4_properties_by_type", "SELECT 'Patient' AS label, 'name' AS property, count(name) AS filled FROM nodes WHERE label = 'Patient' UNION ALL SELECT 'Patient', 'uri', count(uri) FROM nodes WHERE label = 'Patient'")
def q1_4(t):
    filled = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("uri"), F.col("uri")), lambda _, v: v.isNotNull())
    keys = t.nodes.where("label = 'Patient'").select("label", F.explode(F.map_keys(filled)).alias("property"))
    return keys.groupBy("label", "property").agg(F.count("*").alias("filled"))


@query("q2_1_demographics", "SELECT gender, count(*) AS n, round(avg(age), 6) AS age, round(stddev_samp(age), 6) AS sd, round(avg(edu), 6) AS edu FROM patients GROUP BY 1")
def q2_1(t):
    return t.patients.groupBy("gender").agg(F.count("*").alias("n"), F.round(F.avg("age"), 6).alias("age"), F.round(F.stddev_samp("age"), 6).alias("sd"), F.round(F.avg("edu"), 6).alias("edu"))


@query("q2_2_apoe_risk", "SELECT genotype, count(*) AS n, CASE WHEN genotype = 'E4/E4' THEN 'high' WHEN genotype LIKE '%E4%' THEN 'elevated' ELSE 'average' END AS risk FROM patients WHERE genotype IS NOT NULL GROUP BY ALL")
def q2_2(t):
    k = clean.count_allele(F.col("genotype"))
    return _n(t.patients.where("genotype is not null"), "genotype", F.when(k == 2, "high").when(k == 1, "elevated").otherwise("average").alias("risk"))


@query("q2_3_visits_per_patient", "SELECT visits, count(*) AS patients FROM (SELECT pid, count(*) AS visits FROM visits GROUP BY 1) GROUP BY 1")
def q2_3(t):
    return t.visits.groupBy("pid").agg(F.count("*").alias("visits")).groupBy("visits").agg(F.count("*").alias("patients"))


@query("q2_4_follow_up", "SELECT CASE WHEN m < 12 THEN '<1y' WHEN m < 36 THEN '1-3y' WHEN m < 60 THEN '3-5y' ELSE '5y+' END AS band, count(*) AS patients FROM (SELECT pid, max(months) AS m FROM visits GROUP BY 1) GROUP BY 1")
def q2_4(t):
    m = F.col("m")
    return t.visits.groupBy("pid").agg(F.max("months").alias("m")).groupBy(F.when(m < 12, "<1y").when(m < 36, "1-3y").when(m < 60, "3-5y").otherwise("5y+").alias("band")).agg(F.count("*").alias("patients"))


@query("q3_1_diagnoses", "SELECT dx, count(*) AS n, count(DISTINCT pid) AS patients FROM visits GROUP BY 1")
def q3_1(t):
    return t.visits.groupBy("dx").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("patients"))


@query("q3_2_trajectories", "SELECT a.dx AS dx_1, b.dx AS dx_2, count(DISTINCT a.pid) AS patients FROM visits a JOIN visits b ON a.pid = b.pid AND a.months < b.months AND a.dx <> b.dx GROUP BY ALL ORDER BY patients DESC, dx_1, dx_2 LIMIT 10")
def q3_2(t):
    # earliest and latest month of a diagnosis decide whether an ordered pair exists, so the join is of at most one row a diagnosis
    span = t.visits.groupBy("pid", "dx").agg(F.min("months").alias("first"), F.max("months").alias("last"))
    a, b = span.select("pid", F.col("dx").alias("dx_1"), "first"), span.select("pid", F.col("dx").alias("dx_2"), "last")
    return a.join(b, "pid").where("dx_1 <> dx_2 and first < last").groupBy("dx_1", "dx_2").agg(F.count_distinct("pid").alias("patients")).orderBy(F.desc("patients"), "dx_1", "dx_2").limit(10)


@query("q3_3_time_to_progression", "SELECT CASE WHEN gap <= 12 THEN '0-12' WHEN gap <= 24 THEN '13-24' ELSE '25+' END AS band, count(*) AS patients, round(avg(gap), 6) AS mean FROM (SELECT a.pid, min(b.months - a.months) AS gap FROM visits a JOIN visits b ON a.pid = b.pid AND a.months < b.months WHERE a.dx = 'MCI' AND b.dx = 'AD' GROUP BY 1) GROUP BY 1")
def q3_3(t):
    k = F.col("gap")
    rows = r.min_gap(t.visits, "pid", "months", "dx", "MCI", "AD")
    return rows.groupBy(F.when(k <= 12, "0-12").when(k <= 24, "13-24").otherwise("25+").alias("band")).agg(F.count("*").alias("patients"), F.round(F.avg("gap"), 6).alias("mean"))


@query("q4_1_biomarker_availability", "SELECT analyte, count(*) AS n, count(DISTINCT pid) AS patients, round(100 * count(DISTINCT pid) / (SELECT count(*) FROM patients), 4) AS pct FROM facts GROUP BY 1")
def q4_1(t):
    rows = t.facts.groupBy("analyte").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("patients"))
    return rows.crossJoin(t.patients.agg(F.count("*").alias("_t"))).select("analyte", "n", "patients", F.round(100 * F.col("patients") / F.col("_t"), 4).alias("pct"))


@query("q4_3_biomarker_courses", "SELECT analyte, CASE WHEN l > f THEN 'rising' WHEN l < f THEN 'falling' ELSE 'flat' END AS course, count(*) AS patients FROM (SELECT pid, analyte, first(value ORDER BY months, vid, line, value) AS f, last(value ORDER BY months, vid, line, value) AS l, count(*) AS n FROM facts GROUP BY ALL) WHERE n >= 2 GROUP BY ALL")
def q4_3(t):
    rows = r.first_last(t.facts, ["pid", "analyte"], ["months", "vid", "line", "value"], "value", "months")
    return rows.groupBy("analyte", F.expr("CASE WHEN last_value > first_value THEN 'rising' WHEN last_value < first_value THEN 'falling' ELSE 'flat' END").alias("course")).agg(F.count("*").alias("patients"))


@query("q4_4_abnormal_combinations", "SELECT key, count(*) AS patients FROM (SELECT pid, string_agg(DISTINCT analyte, '+' ORDER BY analyte) AS key FROM facts WHERE abnormal = 1 AND months = 0 GROUP BY 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def q4_4(t):
    keys = t.facts.where("abnormal = 1 and months = 0").groupBy("pid").agg(F.array_join(F.array_sort(F.collect_set("analyte")), "+").alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("patients")).orderBy(F.desc("patients"), "key").limit(15)


@query("q4_5_biomarker_correlation", "SELECT round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM (SELECT pid, months, avg(value) AS v FROM facts WHERE analyte = 'TAU' GROUP BY ALL) a JOIN (SELECT pid, months, avg(value) AS v FROM facts WHERE analyte = 'PTAU' GROUP BY ALL) b ON a.pid = b.pid AND a.months = b.months")
def q4_5(t):
    wide = t.facts.where("analyte in ('TAU', 'PTAU')").groupBy("pid", "months").pivot("analyte", ["TAU", "PTAU"]).agg(F.avg("value")).where("TAU is not null and PTAU is not null")
    return wide.agg(F.round(F.corr("TAU", "PTAU"), 6).alias("r"), F.count("*").alias("n"))


@query("q5_2_cognitive_decline", "SELECT CASE WHEN f - l >= 3 THEN 'declining' WHEN l - f >= 2 THEN 'improving' ELSE 'stable' END AS course, count(*) AS patients, round(avg(l - f), 6) AS mean_change FROM (SELECT pid, min_by(mmse, months * 10000000 + vid) AS f, max_by(mmse, months * 10000000 + vid) AS l, count(*) AS n FROM visits GROUP BY 1) WHERE n >= 2 GROUP BY 1")
def q5_2(t):
    rows = r.first_last(t.visits, ["pid"], ["months", "vid"], "mmse", "months")
    course = F.expr("CASE WHEN first_value - last_value >= 3 THEN 'declining' WHEN last_value - first_value >= 2 THEN 'improving' ELSE 'stable' END")
    return rows.groupBy(course.alias("course")).agg(F.count("*").alias("patients"), F.round(F.avg(F.expr("last_value - first_value")), 6).alias("mean_change"))


@query("q5_3_scores_by_diagnosis", "SELECT dx, count(*) AS n, round(avg(mmse), 6) AS mean, round(stddev_samp(mmse), 6) AS sd, round(median(mmse), 6) AS median FROM visits GROUP BY 1")
def q5_3(t):
    moments = t.visits.groupBy("dx").agg(F.count("*").alias("n"), F.round(F.avg("mmse"), 6).alias("mean"), F.round(F.stddev_samp("mmse"), 6).alias("sd"))
    middle = r.quantiles(t.visits.select("dx", F.col("mmse").cast("double").alias("mmse")), "dx", "mmse", {"median": 0.5})
    return moments.join(middle.select("dx", F.round("median", 6).alias("median")), "dx", "left")


@query("q6_2_genetic_and_family", "SELECT CASE WHEN genotype LIKE '%E4%' THEN 'carrier' ELSE 'non-carrier' END AS apoe, n > 0 AS family, count(*) AS patients FROM (SELECT p.pid, genotype, coalesce(n, 0) AS n FROM patients p LEFT JOIN (SELECT pid, count(*) AS n FROM visits WHERE dx = 'AD' GROUP BY 1) v ON p.pid = v.pid WHERE genotype IS NOT NULL) GROUP BY ALL")
def q6_2(t):
    rows = r.optional_counts(t.patients.where("genotype is not null").select("pid", "genotype"), "pid", {"ad": t.visits.where("dx = 'AD'")})
    return rows.groupBy(F.when(F.col("genotype").contains("E4"), "carrier").otherwise("non-carrier").alias("apoe"), (F.col("n_ad") > 0).alias("family")).agg(F.count("*").alias("patients"))


@query("q7_2_imaging_coverage", "SELECT scans, count(*) AS patients FROM (SELECT pid, count(DISTINCT months) AS scans FROM facts WHERE analyte IN ('NFL', 'GFAP') GROUP BY 1) GROUP BY 1")
def q7_2(t):
    return t.facts.where("analyte in ('NFL', 'GFAP')").groupBy("pid").agg(F.count_distinct("months").alias("scans")).groupBy("scans").agg(F.count("*").alias("patients"))


@query("q8_2_risk_and_outcome", "SELECT CASE WHEN age > 75 THEN 'old' ELSE 'young' END AS grp, count(*) AS n, count(*) FILTER (WHERE p.pid IN (SELECT pid FROM visits WHERE dx = 'AD')) AS ad FROM patients p GROUP BY 1")
def q8_2(t):
    ad = t.visits.where("dx = 'AD'").select("pid").distinct().withColumn("ad", F.lit(1))
    return t.patients.join(ad, "pid", "left").groupBy(F.when(F.col("age") > 75, "old").otherwise("young").alias("grp")).agg(F.count("*").alias("n"), F.count("ad").alias("ad"))


@query("q9_1_multimodal_completeness", "SELECT (n_visits > 0)::int + (n_facts > 0)::int + (n_scans > 0)::int AS modalities, count(*) AS patients FROM (SELECT p.pid, coalesce(v.n, 0) AS n_visits, coalesce(f.n, 0) AS n_facts, coalesce(s.n, 0) AS n_scans FROM patients p LEFT JOIN (SELECT pid, count(*) n FROM visits GROUP BY 1) v ON v.pid = p.pid LEFT JOIN (SELECT pid, count(*) n FROM facts GROUP BY 1) f ON f.pid = p.pid LEFT JOIN (SELECT pid, count(*) n FROM facts WHERE analyte = 'NFL' GROUP BY 1) s ON s.pid = p.pid) GROUP BY 1")
def q9_1(t):
    rows = r.optional_counts(t.patients.select("pid"), "pid", {"visits": t.visits, "facts": t.facts, "scans": t.facts.where("analyte = 'NFL'")})
    return rows.groupBy(F.expr("int(n_visits > 0) + int(n_facts > 0) + int(n_scans > 0)").alias("modalities")).agg(F.count("*").alias("patients"))


@query("q9_2_rapid_progressors", "SELECT a.pid, min(b.months - a.months) AS gap FROM visits a JOIN visits b ON a.pid = b.pid AND a.months < b.months WHERE a.dx = 'CN' AND b.dx = 'AD' GROUP BY 1 HAVING min(b.months - a.months) < 12 ORDER BY gap, a.pid LIMIT 20")
def q9_2(t):
    return r.min_gap(t.visits, "pid", "months", "dx", "CN", "AD").where("gap < 12").orderBy("gap", "pid").limit(20)


@query("q9_3_protective_factors", "SELECT gender, round(avg(edu), 6) AS edu, count(*) AS n FROM patients p WHERE genotype LIKE '%E4%' AND pid IN (SELECT pid FROM visits) AND pid NOT IN (SELECT pid FROM visits WHERE dx = 'AD') GROUP BY 1")
def q9_3(t):
    free = r.without(t.patients.where("genotype like '%E4%'").join(t.visits.select("pid").distinct(), "pid", "left_semi"), t.visits.where("dx = 'AD'"), "pid")
    return free.groupBy("gender").agg(F.round(F.avg("edu"), 6).alias("edu"), F.count("*").alias("n"))


@query("q9_4_biomarker_cascade", "SELECT key, count(*) AS patients FROM (SELECT pid, string_agg(analyte, '>' ORDER BY since, analyte) AS key FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY since, analyte) AS k FROM (SELECT pid, analyte, min(months) AS since FROM facts WHERE abnormal = 1 GROUP BY ALL)) WHERE k <= 3 GROUP BY 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q9_4(t):
    keys = r.first_keys(t.facts.where("abnormal = 1"), "pid", ["months"], "analyte")
    return keys.groupBy("key").agg(F.count("*").alias("patients")).orderBy(F.desc("patients"), "key").limit(10)


@query("q10_2_consistency", "SELECT vid, pid FROM visits WHERE dx = 'AD' AND mmse >= 28 ORDER BY vid LIMIT 20")
def q10_2(t):
    return t.visits.where("dx = 'AD' and mmse >= 28").orderBy("vid").select("vid", "pid").limit(20)


@query("q11_2_matched_pairs", "SELECT gender, count(*) AS pairs, round(avg(gap), 6) AS mean_gap FROM (SELECT a.pid, a.gender, abs(a.age - b.age) AS gap, row_number() OVER (PARTITION BY a.pid ORDER BY abs(a.age - b.age), b.pid) AS k FROM patients a JOIN patients b ON a.gender = b.gender AND abs(a.age - b.age) <= 5 AND a.pid <> b.pid WHERE a.segment = 'FURNITURE' AND b.segment = 'HOUSEHOLD') WHERE k = 1 GROUP BY 1")
def q11_2(t):
    pairs = r.nearest_partner(t.patients.where("segment = 'FURNITURE'"), t.patients.where("segment = 'HOUSEHOLD'"), "gender", "age", "pid", "pid", 5)
    return pairs.join(t.patients.select(F.col("pid").alias("case_id"), "gender"), "case_id").groupBy("gender").agg(F.count("*").alias("pairs"), F.round(F.avg("gap"), 6).alias("mean_gap"))


@query("q12_1_similarity_network", "SELECT genotype, count(*) AS pairs FROM patients a JOIN (SELECT pid AS q, genotype AS h, acctbal AS c FROM patients) b ON a.genotype = b.h AND a.pid < b.q AND abs(a.acctbal - b.c) <= 50 GROUP BY 1")
def q12_1(t):
    near = r.band_counts(t.patients, "genotype", "acctbal", "pid", 50.0, difference=True)
    return near.groupBy("genotype").agg((F.sum("near") / 2).cast("long").alias("pairs")).where("pairs > 0")


@query("q12_2_influence_network", "SELECT a.analyte AS predictor, b.analyte AS outcome, count(DISTINCT a.pid) AS patients FROM facts a JOIN facts b ON a.pid = b.pid AND a.months < b.months AND a.abnormal = 1 AND b.abnormal = 1 AND a.analyte <> b.analyte GROUP BY ALL")
def q12_2(t):
    span = t.facts.where("abnormal = 1").groupBy("pid", "analyte").agg(F.min("months").alias("first"), F.max("months").alias("last"))
    a, b = span.select("pid", F.col("analyte").alias("predictor"), "first"), span.select("pid", F.col("analyte").alias("outcome"), "last")
    return a.join(b, "pid").where("predictor <> outcome and first < last").groupBy("predictor", "outcome").agg(F.count_distinct("pid").alias("patients"))


@query("b1_1_high_risk", "SELECT pid, n AS abnormal FROM (SELECT pid, count(DISTINCT analyte) AS n FROM facts WHERE abnormal = 1 GROUP BY 1) WHERE n = 6 ORDER BY pid LIMIT 50")
def b1_1(t):
    return t.facts.where("abnormal = 1").groupBy("pid").agg(F.count_distinct("analyte").alias("abnormal")).where("abnormal = 6").orderBy("pid").select("pid", "abnormal").limit(50)


@query("b3_1_patient_timeline", "SELECT months, analyte, round(avg(value), 6) AS value FROM facts WHERE pid = 7 GROUP BY ALL")
def b3_1(t):
    return t.facts.where("pid = 7").groupBy("months", "analyte").agg(F.round(F.avg("value"), 6).alias("value"))


@query("b3_3_patient_journey", "SELECT v.vid, v.months, v.dx, coalesce(string_agg(DISTINCT f.analyte, ',' ORDER BY f.analyte), '') AS markers FROM visits v LEFT JOIN facts f ON v.vid = f.vid GROUP BY ALL")
def b3_3(t):
    marks = t.facts.groupBy("vid").agg(F.array_join(F.array_sort(F.collect_set("analyte")), ",").alias("markers"))
    return t.visits.join(marks, "vid", "left").select("vid", "months", "dx", F.coalesce("markers", F.lit("")).alias("markers"))


@query("b4_3_marker_and_decline", "SELECT analyte, count(DISTINCT v.pid) AS patients FROM (SELECT pid, months FROM (SELECT pid, months, lag(mmse) OVER (PARTITION BY pid ORDER BY months, vid) - mmse AS loss FROM visits) WHERE loss >= 3) v JOIN facts f ON v.pid = f.pid AND f.months <= v.months AND abnormal = 1 GROUP BY 1")
def b4_3(t):
    loss = F.lag("mmse").over(Window.partitionBy("pid").orderBy("months", "vid")) - F.col("mmse")
    decline = t.visits.withColumn("loss", loss).where("loss >= 3").groupBy("pid").agg(F.max("months").alias("m"))
    first = t.facts.where("abnormal = 1").groupBy("pid", "analyte").agg(F.min("months").alias("since"))
    return decline.join(first, "pid").where("since <= m").groupBy("analyte").agg(F.count_distinct("pid").alias("patients"))


@query("x3_3_stage_transitions", "SELECT f AS from_stage, dx AS to_stage, count(*) AS n FROM (SELECT dx, lag(dx) OVER (PARTITION BY pid ORDER BY months, vid) AS f FROM visits) WHERE f <> dx GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 20")
def x3_3(t):
    rows = r.changes(t.visits, ["pid"], ["months", "vid"], "dx").groupBy(F.col("from_value").alias("from_stage"), F.col("dx").alias("to_stage")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "from_stage", "to_stage").limit(20)


@query("x4_3_decline_over_time", "SELECT months, count(*) AS n, round(avg(mmse), 6) AS mean FROM visits GROUP BY 1 ORDER BY months LIMIT 30")
def x4_3(t):
    return t.visits.groupBy("months").agg(F.count("*").alias("n"), F.round(F.avg("mmse"), 6).alias("mean")).orderBy("months").limit(30)


@query("x8_4_code_coverage", "SELECT count(*) AS total, count(*) FILTER (WHERE dx <> 'SMC') AS coded, round(100 * count(*) FILTER (WHERE dx <> 'SMC') / count(*), 4) AS pct FROM visits")
def x8_4(t):
    coded = F.count_if(F.col("dx") != "SMC")
    return t.visits.agg(F.count("*").alias("total"), coded.alias("coded"), F.round(100 * coded / F.count("*"), 4).alias("pct"))


@query("x8_7_hierarchy_walk", "SELECT concat('N:', n_nationkey) AS descendant, concat('R:', n_regionkey) AS ancestor, 1 AS depth FROM nation UNION ALL SELECT concat('P:', c_custkey), concat('R:', n_regionkey), 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 9 UNION ALL SELECT concat('P:', c_custkey), concat('N:', c_nationkey), 1 FROM customer WHERE c_custkey % 10 <> 9")
def x8_7(t):
    return g.closure(t.edges.where("type in ('IS_A', 'LIVES_IN')").withColumn("type", F.lit("IS_A")), "IS_A", 3)


@query("x9_4_precedes_chains", "SELECT pid, count(*) AS steps, max(gap) AS widest FROM (SELECT pid, lead(months) OVER (PARTITION BY pid ORDER BY months) - months AS gap FROM (SELECT DISTINCT pid, months FROM visits)) WHERE gap IS NOT NULL GROUP BY 1")
def x9_4(t):
    return r.next_distinct(t.visits, "pid", "months").groupBy("pid").agg(F.count("*").alias("steps"), F.max("gap").alias("widest"))


@query("x10_1_hub_nodes", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY degree DESC, id LIMIT 20")
def x10_1(t):
    return g.degrees(t.edges).orderBy(F.desc("degree"), "id").limit(20)


@query("x11_1_full_profile", "SELECT p.pid, gender, age, dx, m.mmse, f.n_abnormal FROM patients p LEFT JOIN (SELECT pid, max_by(dx, months * 10000000 + vid) AS dx FROM visits GROUP BY 1) v ON p.pid = v.pid LEFT JOIN (SELECT pid, min(mmse) AS mmse FROM visits GROUP BY 1) m ON p.pid = m.pid LEFT JOIN (SELECT pid, sum(abnormal)::bigint AS n_abnormal FROM facts GROUP BY 1) f ON p.pid = f.pid")
def x11_1(t):
    seen = t.visits.groupBy("pid").agg(F.max_by("dx", F.struct("months", "vid")).alias("dx"), F.min("mmse").alias("mmse"))
    return t.patients.select("pid", "gender", "age").join(seen, "pid", "left").join(t.facts.groupBy("pid").agg(F.sum("abnormal").alias("n_abnormal")), "pid", "left")


@query("x11_2_confirmed_pathology", "SELECT DISTINCT v.pid FROM visits v JOIN facts f ON v.pid = f.pid WHERE dx = 'AD' AND mmse < 10 AND analyte = 'ABETA42' AND value < 10")
def x11_2(t):
    return t.visits.where("dx = 'AD' and mmse < 10").select("pid").distinct().join(t.facts.where("analyte = 'ABETA42' and value < 10"), "pid", "left_semi")


@query("x11_4_hops_to_concept", "SELECT hops, count(*) AS n FROM (SELECT 1 AS hops FROM edges WHERE type = 'LIVES_IN' UNION ALL SELECT 2 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'LIVES_IN' AND b.type = 'IS_A') GROUP BY 1")
def x11_4(t):
    one = t.edges.where("type = 'LIVES_IN'").agg(F.lit(1).alias("hops"), F.count("*").alias("n"))
    return one.unionByName(g.chain(t.edges, "LIVES_IN", "IS_A").agg(F.lit(2).alias("hops"), F.count("*").alias("n")))


@query("x12_7_conflicting_diagnoses", "SELECT pid, months, count(DISTINCT dx) AS k FROM visits GROUP BY ALL HAVING count(DISTINCT dx) > 1")
def x12_7(t):
    return t.visits.groupBy("pid", "months").agg(F.count_distinct("dx").alias("k")).where("k > 1")


@query("x12_8_property_inventory", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def x12_8(t):
    return t.events.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
