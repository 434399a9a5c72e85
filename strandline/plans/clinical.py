"""Queries over derived entities and the event model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import clean
from strandline.operators import clinical as c
from strandline.operators import relational as r
from strandline.plans.cohort import query

_ATN = "SELECT pid, concat('A', CASE WHEN a THEN '+' ELSE '-' END, 'T', CASE WHEN t THEN '+' ELSE '-' END, 'N', CASE WHEN n THEN '+' ELSE '-' END) AS profile, a::int + t::int + n::int AS n_positive FROM (SELECT pid, coalesce(bool_or(CASE WHEN analyte = 'ABETA42' THEN value < 8 END), false) AS a, coalesce(bool_or(CASE WHEN analyte = 'PTAU' THEN value > 42 END), false) AS t, coalesce(bool_or(CASE WHEN analyte = 'TAU' THEN value > 42 END), false) AS n FROM facts GROUP BY 1)"
_STEP = "SELECT pid, vid, months, lag(dx) OVER w AS f, dx AS l, months - lag(months) OVER w AS gap FROM visits WINDOW w AS (PARTITION BY pid ORDER BY months, vid)"
_RANK = "CASE {} WHEN 'CN' THEN 0 WHEN 'SMC' THEN 1 WHEN 'MCI' THEN 3 ELSE 5 END"


def _atn(t):
    return c.atn_profile(t.facts, "pid", ("ABETA42", "PTAU", "TAU"), (8.0, 42.0, 42.0))


@query("d01_atn_profile", _ATN)
def d01(t):
    return _atn(t)


@query("d02_atn_interpretation", f"SELECT profile, count(*) AS n, CASE WHEN profile = 'A-T-N-' THEN 'Normal biomarkers' WHEN profile = 'A+T-N-' THEN 'Alzheimer''s pathologic change' WHEN profile LIKE 'A+T+%' THEN 'Alzheimer''s disease' WHEN profile = 'A+T-N+' THEN 'Alzheimer''s and suspected non-Alzheimer''s change' ELSE 'Non-Alzheimer''s pathologic change' END AS text FROM ({_ATN}) GROUP BY profile")
def d02(t):
    return _atn(t).groupBy("profile").agg(F.count("*").alias("n")).withColumn("text", clean.lookup(F.col("profile"), c.ATN_TEXTS))


@query("d03_biomarker_profile", "SELECT pid, count(*) AS n, sum(abnormal)::bigint AS n_abnormal, round(avg(value) FILTER (WHERE analyte = 'TAU'), 4) AS tau, least(10.0, 3.0 * count(DISTINCT analyte))::double AS risk FROM facts WHERE months = 0 GROUP BY 1")
def d03(t):
    rows = c.biomarker_profile(t.facts.where("months = 0"), "pid")
    return rows.select("pid", "n", "n_abnormal", F.element_at("markers", "TAU").alias("tau"), F.least(F.lit(10.0), 3.0 * F.size("markers")).alias("risk"))


@query("d04_genetic_risk", "SELECT pid, CASE genotype WHEN 'E4/E4' THEN 12.0 WHEN 'E3/E4' THEN 3.0 WHEN 'E2/E4' THEN 2.5 WHEN 'E3/E3' THEN 1.0 ELSE 0.6 END::double AS factor, CASE genotype WHEN 'E4/E4' THEN 'very high' WHEN 'E3/E4' THEN 'high' WHEN 'E2/E4' THEN 'moderate' WHEN 'E3/E3' THEN 'average' ELSE 'low' END AS level FROM patients WHERE genotype IS NOT NULL")
def d04(t):
    f = F.col("factor")
    rows = t.patients.where("genotype is not null").select("pid", clean.genotype_risk(F.col("genotype")).alias("factor"))
    return rows.withColumn("level", F.when(f >= 12, "very high").when(f >= 3, "high").when(f >= 2, "moderate").when(f >= 1, "average").otherwise("low"))


@query("d05_family_risk", "SELECT p.pid, CASE WHEN genotype = 'E4/E4' THEN 12.0 WHEN genotype LIKE '%E4' THEN 3.0 ELSE 1.0 END * (1 + 0.5 * coalesce(n, 0))::double AS score FROM patients p LEFT JOIN (SELECT pid, count(*) AS n FROM visits WHERE dx = 'AD' GROUP BY 1) v ON p.pid = v.pid WHERE genotype IS NOT NULL")
def d05(t):
    rows = r.optional_counts(t.patients.where("genotype is not null").select("pid", "genotype"), "pid", {"ad": t.visits.where("dx = 'AD'")})
    base = F.when(F.col("genotype") == "E4/E4", 12.0).when(F.col("genotype").endswith("E4"), 3.0).otherwise(1.0)
    return rows.select("pid", (base * (1 + 0.5 * F.col("n_ad"))).alias("score"))


@query("d06_research_cohort", f"SELECT cohort, segment, count(*) AS size FROM (SELECT pid, max_by(dx, {_RANK.format('dx')}) AS cohort FROM visits GROUP BY 1) v JOIN patients p ON v.pid = p.pid GROUP BY ALL HAVING count(*) >= 2")
def d06(t):
    return c.cohort_of(t.visits).join(t.patients, "pid").groupBy("cohort", "segment").agg(F.count("*").alias("size")).where("size >= 2")


@query("d07_multimodal", "SELECT vid, count(*) AS n, string_agg(DISTINCT analyte, ',' ORDER BY analyte) AS names FROM facts GROUP BY 1 HAVING count(*) >= 2")
def d07(t):
    return t.facts.groupBy("vid").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("analyte")), ",").alias("names")).where("n >= 2")


@query("d09_disease_stage", "SELECT p.pid, stage, months AS typical_months FROM (SELECT pid, max_by(CASE dx WHEN 'MCI' THEN 'LMCI' ELSE dx END, months * 10000000 + vid) AS stage FROM visits GROUP BY 1) p LEFT JOIN (VALUES ('CN', 36), ('MCI', 18), ('LMCI', 24)) s(st, months) ON st = stage")
def d09(t):
    stages = t.spark.createDataFrame([(a, m) for a, _, m in c.STAGE_MONTHS], "stage string, typical_months int")
    latest = r.pick(t.visits, ["pid"], [F.desc("months"), F.desc("vid")]).select("pid", F.expr("CASE dx WHEN 'MCI' THEN 'LMCI' ELSE dx END").alias("stage"))
    return latest.join(F.broadcast(stages), "stage", "left").select("pid", "stage", "typical_months")


@query("d10_pattern_match", "SELECT p.pattern, count(*) AS n FROM facts f JOIN (VALUES ('ABETA42', 'amyloid', 0.0, 10.0), ('ABETA40', 'amyloid', 0.0, 5.0), ('TAU', 'tau', 40.0, 99.0), ('PTAU', 'tau', 45.0, 99.0)) p(alias, pattern, lo, hi) ON f.analyte = p.alias AND value >= lo AND value < hi GROUP BY 1")
def d10(t):
    rules = t.spark.createDataFrame([("ABETA42", "amyloid", 0.0, 10.0), ("ABETA40", "amyloid", 0.0, 5.0), ("TAU", "tau", 40.0, 99.0), ("PTAU", "tau", 45.0, 99.0)], "analyte string, pattern string, lo double, hi double")
    return t.facts.join(F.broadcast(rules), "analyte").where("value >= lo and value < hi").groupBy("pattern").agg(F.count("*").alias("n"))


@query("d11_risk_factors", "SELECT pid, 'APOE4' AS factor FROM patients WHERE genotype LIKE '%E4%' UNION ALL SELECT pid, 'AGE' FROM patients WHERE age > 75 UNION ALL SELECT DISTINCT pid, 'HISTORY' FROM visits WHERE dx = 'AD'")
def d11(t):
    p = t.patients
    parts = [p.where("genotype like '%E4%'").select("pid", F.lit("APOE4").alias("factor")), p.where("age > 75").select("pid", F.lit("AGE").alias("factor")), t.visits.where("dx = 'AD'").select("pid", F.lit("HISTORY").alias("factor")).distinct()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("d12_phenotype", "SELECT v.pid, CASE WHEN stage = 'AD' AND a THEN 'AD biomarker positive' WHEN stage = 'AD' THEN 'AD clinical' WHEN stage = 'MCI' AND a THEN 'prodromal' WHEN stage = 'MCI' THEN 'MCI' WHEN a THEN 'preclinical' ELSE 'normal' END AS phenotype FROM (SELECT pid, max_by(dx, months * 10000000 + vid) AS stage FROM visits GROUP BY 1) v LEFT JOIN (SELECT pid, bool_or(analyte = 'ABETA42' AND value < 8) AS a FROM facts GROUP BY 1) f ON v.pid = f.pid")
def d12(t):
    stage = t.visits.groupBy("pid").agg(F.max_by("dx", F.struct("months", "vid")).alias("stage"))
    amyloid = t.facts.groupBy("pid").agg(F.bool_or((F.col("analyte") == "ABETA42") & (F.col("value") < 8)).alias("a"))
    s, a = F.col("stage"), F.coalesce("a", F.lit(False))
    kind = F.when((s == "AD") & a, "AD biomarker positive").when(s == "AD", "AD clinical").when((s == "MCI") & a, "prodromal").when(s == "MCI", "MCI").when(a, "preclinical").otherwise("normal")
    return stage.join(amyloid, "pid", "left").select("pid", kind.alias("phenotype"))


@query("d13_progression_pattern", f"SELECT pid, vid, f AS from_stage, l AS to_stage, CASE WHEN {_RANK.format('l')} - {_RANK.format('f')} = 1 THEN 'gradual' ELSE 'rapid' END AS speed FROM ({_STEP}) WHERE {_RANK.format('l')} > {_RANK.format('f')} AND f IS NOT NULL")
def d13(t):
    return c.progression(t.visits)


@query("d14_progression_event", "SELECT pid, f AS first_value, l AS last_value, duration FROM (SELECT pid, min_by(dx, months * 10000000 + vid) AS f, max_by(dx, months * 10000000 + vid) AS l, max(months) - min(months) AS duration, count(*) AS n FROM visits GROUP BY 1) WHERE f <> l AND n >= 2")
def d14(t):
    rows = t.visits.groupBy("pid").agg(F.min_by("dx", F.struct("months", "vid")).alias("first_value"), F.max_by("dx", F.struct("months", "vid")).alias("last_value"), F.expr("max(months) - min(months)").alias("duration"))
    return rows.where("first_value <> last_value")


@query("d15_pathway_links", "SELECT DISTINCT pid, CASE WHEN analyte LIKE 'ABETA%' THEN 'amyloid cascade' WHEN analyte LIKE '%TAU' THEN 'tau phosphorylation' ELSE 'neurodegeneration' END AS pathway, CASE WHEN abnormal = 1 THEN 0.9 ELSE 0.3 END::double AS strength FROM facts WHERE months = 0")
def d15(t):
    path = F.expr("CASE WHEN analyte LIKE 'ABETA%' THEN 'amyloid cascade' WHEN analyte LIKE '%TAU' THEN 'tau phosphorylation' ELSE 'neurodegeneration' END")
    return t.facts.where("months = 0").select("pid", path.alias("pathway"), F.expr("CASE WHEN abnormal = 1 THEN 0.9D ELSE 0.3D END").alias("strength")).distinct()


@query("d16_imaging_clinical", "SELECT v.vid, v.dx, count(*) AS n, round(avg(value), 6) AS mean FROM facts f JOIN visits v ON f.vid = v.vid WHERE analyte IN ('NFL', 'GFAP') GROUP BY ALL")
def d16(t):
    return t.facts.where("analyte in ('NFL', 'GFAP')").join(t.visits.select("vid", "dx"), "vid").groupBy("vid", "dx").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("d17_biomarker_category", "SELECT CASE WHEN analyte LIKE 'ABETA%' THEN 'amyloid' WHEN analyte LIKE '%TAU' THEN 'tau' ELSE 'neuronal injury' END AS category, count(*) AS n FROM facts GROUP BY 1")
def d17(t):
    groups = clean.lookup(F.col("analyte"), {"ABETA42": "amyloid", "ABETA40": "amyloid", "TAU": "tau", "PTAU": "tau"})
    return t.facts.groupBy(F.coalesce(groups, F.lit("neuronal injury")).alias("category")).agg(F.count("*").alias("n"))


@query("d18_timeline", "SELECT pid, min(months) AS first_month, max(months) AS last_month, count(*) AS n FROM visits GROUP BY 1 HAVING count(*) >= 2")
def d18(t):
    return t.visits.groupBy("pid").agg(F.min("months").alias("first_month"), F.max("months").alias("last_month"), F.count("*").alias("n")).where("n >= 2")


@query("d19_demographics", "SELECT gender, CASE WHEN age < 65 THEN '<65' WHEN age < 75 THEN '65-74' WHEN age < 85 THEN '75-84' ELSE '85+' END AS age_group, count(*) AS n, round(avg(edu), 6) AS edu FROM patients GROUP BY ALL")
def d19(t):
    return t.patients.groupBy("gender", clean.age_group(F.col("age")).alias("age_group")).agg(F.count("*").alias("n"), F.round(F.avg("edu"), 6).alias("edu"))


@query("d20_clinical_findings", "SELECT concat('finding_', vid, '_', dx) AS finding, pid, vid FROM visits WHERE dx <> 'CN'")
def d20(t):
    return t.visits.where("dx <> 'CN'").select(F.concat(F.lit("finding_"), "vid", F.lit("_"), "dx").alias("finding"), "pid", "vid")


@query("d21_symptom_biomarker", "SELECT v.pid, v.months, analyte, round(avg((mmse / 30 + value / 50) / 2), 6) AS confidence FROM visits v JOIN facts f ON v.pid = f.pid AND v.months = f.months WHERE mmse < 10 AND abnormal = 1 GROUP BY ALL")
def d21(t):
    low = t.visits.where("mmse < 10").select("pid", "months", "mmse")
    return low.join(t.facts.where("abnormal = 1").select("pid", "months", "analyte", "value"), ["pid", "months"]).groupBy("pid", "months", "analyte").agg(F.round(F.avg(F.expr("(mmse / 30 + value / 50) / 2")), 6).alias("confidence"))


@query("d22_test_types", "SELECT DISTINCT concat('test:', analyte) AS src, 'IS_TYPE' AS type, CASE WHEN analyte LIKE 'A%' THEN 'Amyloid' ELSE 'Other' END AS dst FROM facts")
def d22(t):
    return t.facts.select("analyte").distinct().select(F.concat(F.lit("test:"), "analyte").alias("src"), F.lit("IS_TYPE").alias("type"), F.expr("CASE WHEN analyte LIKE 'A%' THEN 'Amyloid' ELSE 'Other' END").alias("dst"))


@query("d23_kaplan_meier", """WITH s AS (SELECT p.pid, segment AS "group", least(coalesce(min(months), 120), 120) AS time, (min(months) IS NOT NULL AND min(months) <= 120)::int AS event FROM patients p LEFT JOIN (SELECT pid, months FROM visits WHERE dx = 'AD' AND months > 0) v ON p.pid = v.pid GROUP BY ALL),
    k AS (SELECT "group", time, sum(event)::bigint AS events, count(*) AS n FROM s GROUP BY ALL), q AS (SELECT *, (sum(n) OVER (PARTITION BY "group" ORDER BY time DESC))::bigint AS at_risk FROM k)
    SELECT "group", time, at_risk, events, survival FROM (SELECT *, round(CASE WHEN min(1 - events / at_risk) OVER w <= 0 THEN 0 ELSE exp(sum(ln(greatest(1 - events / at_risk, 1e-300))) OVER w) END, 6) AS survival FROM q WINDOW w AS (PARTITION BY "group" ORDER BY time)) WHERE events > 0""")  # fmt: skip
def d23(t):
    first = t.visits.where("dx = 'AD' and months > 0").groupBy("pid").agg(F.min("months").alias("t"))
    subjects = t.patients.join(first, "pid", "left").select(F.col("segment").alias("group"), "t", F.coalesce(F.col("t") <= 120, F.lit(False)).alias("event"))
    return c.kaplan_meier(subjects, "group", "t", "event")


@query("d24_trial_eligibility", "SELECT pid FROM patients WHERE age BETWEEN 60 AND 85 AND pid IN (SELECT pid FROM visits WHERE dx = 'MCI' AND mmse BETWEEN 20 AND 27) AND pid IN (SELECT pid FROM facts WHERE analyte = 'ABETA42' AND value < 8)")
def d24(t):
    return t.patients.where("age between 60 and 85").join(t.visits.where("dx = 'MCI' and mmse between 20 and 27"), "pid", "left_semi").join(t.facts.where("analyte = 'ABETA42' and value < 8"), "pid", "left_semi").select("pid")


@query("d25_preclinical", "SELECT n_abnormal, count(*) AS visits FROM (SELECT v.vid, count(DISTINCT analyte) AS n_abnormal FROM visits v JOIN facts f ON v.vid = f.vid WHERE dx = 'CN' AND abnormal = 1 GROUP BY 1) GROUP BY 1")
def d25(t):
    bad = t.facts_by_visit.where("abnormal = 1").groupBy("vid").agg(F.count_distinct("analyte").alias("n_abnormal"))
    return t.visits.where("dx = 'CN'").join(bad, "vid").groupBy("n_abnormal").agg(F.count("*").alias("visits"))


@query("d26_stage_from_severity", "SELECT CASE WHEN mmse >= 24 THEN 'Preclinical' WHEN mmse >= 18 THEN 'Mild' WHEN mmse >= 10 THEN 'Moderate' ELSE 'Severe' END AS stage, count(*) AS n FROM visits GROUP BY 1")
def d26(t):
    m = F.col("mmse")
    return t.visits.groupBy(F.when(m >= 24, "Preclinical").when(m >= 18, "Mild").when(m >= 10, "Moderate").otherwise("Severe").alias("stage")).agg(F.count("*").alias("n"))


@query("d27_consistency", "SELECT 'ad_high_mmse' AS check_name, count(*) AS n FROM visits WHERE dx = 'AD' AND mmse >= 28 UNION ALL SELECT 'several_at_baseline', count(*) FROM (SELECT pid FROM visits WHERE months = 0 GROUP BY 1 HAVING count(DISTINCT dx) > 1) UNION ALL SELECT 'out_of_order', count(*) FROM (SELECT vid, vdate < lag(vdate) OVER (PARTITION BY pid ORDER BY months, vid) AS bad FROM visits) WHERE bad")
def d27(t):
    one = lambda rows, name: rows.agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))
    several = t.visits.where("months = 0").groupBy("pid").agg(F.count_distinct("dx").alias("k")).where("k > 1")
    order = t.visits.withColumn("bad", F.col("vdate") < F.lag("vdate").over(Window.partitionBy("pid").orderBy("months", "vid"))).where("bad")
    return one(t.visits.where("dx = 'AD' and mmse >= 28"), "ad_high_mmse").unionByName(one(several, "several_at_baseline")).unionByName(one(order, "out_of_order"))


@query("d28_family_checks", "SELECT pid, CASE WHEN pid % 7 = 0 THEN 'relation' WHEN 40 + edu * 3 > age THEN 'onset_after_age' END AS error FROM patients WHERE pid % 7 = 0 OR 40 + edu * 3 > age")
def d28(t):
    rows = t.patients.select("pid", "age", F.expr("CASE WHEN pid % 7 = 0 THEN 'friend' ELSE 'mother' END").alias("relation"), F.expr("40 + edu * 3").alias("onset"))
    error = F.when(~F.col("relation").isin("mother", "father", "sibling", "child", "grandparent"), "relation").when(F.col("onset") > F.col("age"), "onset_after_age")
    return rows.select("pid", error.alias("error")).where("error is not null")


@query("d29_genetic_contribution", "SELECT pid, round(least(1.0, sum(w)), 6) AS contribution, count(*) AS relations FROM (SELECT pid, CASE status WHEN 'F' THEN 0.3 WHEN 'O' THEN 0.25 ELSE 0.05 END * CASE WHEN mmse < 10 THEN 1.5 ELSE 1.0 END::double AS w FROM visits WHERE dx = 'AD') GROUP BY 1")
def d29(t):
    w = F.expr("CASE status WHEN 'F' THEN 0.3D WHEN 'O' THEN 0.25D ELSE 0.05D END * CASE WHEN mmse < 10 THEN 1.5D ELSE 1.0D END")
    return t.visits.where("dx = 'AD'").groupBy("pid").agg(F.round(F.least(F.lit(1.0), F.sum(w)), 6).alias("contribution"), F.count("*").alias("relations"))


@query("d30_patient_overview", "SELECT p.pid, gender, age, coalesce(v.n, 0) AS n_visits, v.dxs, coalesce(f.n, 0) AS n_facts FROM patients p LEFT JOIN (SELECT pid, count(*) AS n, string_agg(DISTINCT dx, ',' ORDER BY dx) AS dxs FROM visits GROUP BY 1) v ON p.pid = v.pid LEFT JOIN (SELECT pid, count(*) AS n FROM facts GROUP BY 1) f ON p.pid = f.pid")
def d30(t):
    dxs = t.visits.groupBy("pid").agg(F.array_join(F.array_sort(F.collect_set("dx")), ",").alias("dxs"))
    return r.optional_counts(t.patients.select("pid", "gender", "age").join(dxs, "pid", "left"), "pid", {"visits": t.visits, "facts": t.facts})


@query("d31_attribute_grouping", "SELECT pid, concat(gender, age) AS demographic, coalesce(genotype, '') AS genetic FROM patients")
def d31(t):
    rows = c.grouped_maps(t.patients.select("pid", "gender", "age", "genotype", "acctbal"), "pid", {"demographic": ("gender", "age"), "genetic": ("geno",)})
    return rows.select("pid", F.concat(F.element_at("demographic", "gender"), F.element_at("demographic", "age")).alias("demographic"), F.coalesce(F.element_at("genetic", "genotype"), F.lit("")).alias("genetic"))


@query("d32_family_wide_rows", "SELECT concat('fm_', substring(md5(concat(pid, '_mother')), 1, 12)) AS member, pid, edu AS onset FROM patients")
def d32(t):
    return t.patients.select(F.concat(F.lit("fm_"), F.substring(F.md5(F.concat(F.col("pid").cast("string"), F.lit("_mother"))), 1, 12)).alias("member"), "pid", F.coalesce("edu", "age").alias("onset"))


@query("d33_region_networks", "SELECT network, count(*) AS n FROM patients p JOIN (VALUES (0, 'default mode'), (1, 'salience'), (2, 'visual')) r(k, network) ON nation % 3 = k GROUP BY 1")
def d33(t):
    rules = t.spark.createDataFrame([(0, "default mode"), (1, "salience"), (2, "visual")], "k int, network string")
    return t.patients.withColumn("k", F.expr("nation % 3")).join(F.broadcast(rules), "k").groupBy("network").agg(F.count("*").alias("n"))


@query("v01_event_ontology", "SELECT event_type, CASE event_type WHEN 'purchase' THEN 'milestone' WHEN 'signup' THEN 'milestone' WHEN 'error' THEN 'adverse' ELSE 'routine' END AS parent, count(*) AS n FROM events GROUP BY ALL")
def v01(t):
    subtypes = t.spark.createDataFrame([("purchase", "milestone"), ("signup", "milestone"), ("error", "adverse"), ("click", "routine"), ("view", "routine")], "event_type string, parent string")
    return t.events.join(F.broadcast(subtypes), "event_type").groupBy("event_type", "parent").agg(F.count("*").alias("n"))


@query("v02_diagnosis_events", f"SELECT pid, 'diagnosis_change' AS kind, months, f AS from_state, l AS to_state, gap AS duration FROM ({_STEP}) WHERE f <> l")
def v02(t):
    return c.state_changes(t.visits, "pid", ["months", "vid"], "dx", "diagnosis_change")


@query("v03_symptom_onset", "SELECT pid, min(months) AS months FROM visits WHERE mmse < 21 GROUP BY 1")
def v03(t):
    return t.visits.where("mmse < 21").groupBy("pid").agg(F.min("months").alias("months"))


_MARK = "SELECT pid, analyte, months, max(abnormal) AS abnormal FROM facts GROUP BY ALL"


@query("v04_biomarker_events", f"SELECT pid, analyte, months, b AS from_state, abnormal AS to_state FROM (SELECT *, lag(abnormal) OVER (PARTITION BY pid, analyte ORDER BY months) AS b FROM ({_MARK})) WHERE b <> abnormal")
def v04(t):
    marks = t.facts.groupBy("pid", "analyte", "months").agg(F.max("abnormal").alias("abnormal"))
    return r.changes(marks, ["pid", "analyte"], ["months"], "abnormal").select("pid", "analyte", "months", F.col("from_value").alias("from_state"), F.col("abnormal").alias("to_state"))


@query("v05_atn_events", f"SELECT pid, CASE n_positive WHEN 0 THEN 'none' WHEN 3 THEN 'full' ELSE 'partial' END AS stage FROM ({_ATN})")
def v05(t):
    return _atn(t).select("pid", F.when(F.col("n_positive") == 0, "none").when(F.col("n_positive") == 3, "full").otherwise("partial").alias("stage"))


@query("v06_cognitive_decline", "SELECT pid, months, loss FROM (SELECT pid, months, lag(mmse) OVER (PARTITION BY pid ORDER BY months, vid) - mmse AS loss FROM visits) WHERE loss >= 3")
def v06(t):
    return t.visits.withColumn("loss", F.lag("mmse").over(Window.partitionBy("pid").orderBy("months", "vid")) - F.col("mmse")).where("loss >= 3").select("pid", "months", "loss")


@query("v07_imaging_events", "SELECT pid, min(months) AS first_scan FROM facts WHERE analyte = 'GFAP' GROUP BY 1")
def v07(t):
    return t.facts.where("analyte = 'GFAP'").groupBy("pid").agg(F.min("months").alias("first_scan"))


@query("v08_event_chains", "SELECT user_id, count(*) AS n, min(ts) AS start, max(ts) AS stop, string_agg(event_type, '>' ORDER BY ts, event_id) AS sequence FROM events GROUP BY 1")
def v08(t):
    return c.chains(t.events, "user_id", ["ts", "event_id"], "event_type", "ts")


@query("v09_followed_by", "SELECT event_id, lead(event_id) OVER w AS next_event FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY next_event IS NOT NULL")
def v09(t):
    return t.events.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_event")).where("next_event is not null")


@query("v10_v11_markov", f"SELECT *, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS probability FROM (SELECT f AS from_state, l AS to_state, count(*) AS n, round(avg(gap), 6) AS mean_gap FROM ({_STEP}) WHERE f <> l GROUP BY ALL)")
def v10(t):
    steps = c.state_changes(t.visits, "pid", ["months", "vid"], "dx", "x").groupBy("from_state", "to_state").agg(F.count("*").alias("n"), F.round(F.avg("duration"), 6).alias("mean_gap"))
    return c.markov(steps)


@query("v12_patient_timelines", "SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, count(*) FILTER (WHERE event_type = 'purchase') AS milestones FROM events GROUP BY 1")
def v12(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.count_if(F.col("event_type") == "purchase").alias("milestones"))


@query("v13_event_trigrams", "SELECT sequence, n, round(100 * n / sum(n) OVER (), 4) AS pct FROM (SELECT concat(event_type, '>', b, '>', c) AS sequence, count(*) AS n FROM (SELECT event_type, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE c IS NOT NULL GROUP BY 1) QUALIFY n >= 5")
def v13(t):
    return c.trigrams(t.events, "user_id", ["ts", "event_id"], "event_type")


@query("v14_progression_speed", "SELECT a.pid, CASE WHEN min(b.months - a.months) < 24 THEN 'fast' WHEN min(b.months - a.months) < 36 THEN 'rapid' ELSE 'standard' END AS speed FROM visits a JOIN visits b ON a.pid = b.pid AND a.months < b.months WHERE a.dx = 'CN' AND b.dx = 'AD' GROUP BY 1")
def v14(t):
    g = F.col("gap")
    return r.min_gap(t.visits, "pid", "months", "dx", "CN", "AD").select("pid", F.when(g < 24, "fast").when(g < 36, "rapid").otherwise("standard").alias("speed"))


@query("v15_precedence", "SELECT a.event_type AS cause, b.event_type AS effect, count(*) AS n FROM (SELECT event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) a JOIN events b ON a.nx = b.event_id WHERE (a.event_type = 'error' AND b.event_type = 'signup') OR (a.event_type = 'view' AND b.event_type = 'purchase') GROUP BY ALL")
def v15(t):
    rows = t.events.select(F.col("event_type").alias("cause"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("effect"))
    return rows.where("(cause = 'error' and effect = 'signup') or (cause = 'view' and effect = 'purchase')").groupBy("cause", "effect").agg(F.count("*").alias("n"))


@query("v16_event_statistics", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def v16(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("v17_event_category", "SELECT CASE WHEN contains(event_type, 'err') THEN 'adverse' WHEN contains(event_type, 'ur') THEN 'commercial' ELSE 'interaction' END AS category, count(*) AS n FROM events GROUP BY 1")
def v17(t):
    e = F.col("event_type")
    return t.events.groupBy(F.when(e.contains("err"), "adverse").when(e.contains("ur"), "commercial").otherwise("interaction").alias("category")).agg(F.count("*").alias("n"))


@query("v18_fast_chains", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING date_diff('day', min(ts), max(ts)) < 400 AND count(*) >= 3")
def v18(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.datediff(F.max("ts"), F.min("ts")).alias("d")).where("d < 400 and n >= 3").select("user_id", "n")
