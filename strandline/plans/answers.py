"""More end-to-end questions over the cohort, compositions of the library's operators, named by SURVEY section 5.1."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import clean
from strandline.operators import clinical as c
from strandline.operators import nested
from strandline.operators import profiles as p
from strandline.operators import relational as r
from strandline.plans.cohort import query


def _n(rows, *by):
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def _share(n: str = "n"):
    return F.round(100 * F.col(n) / F.sum(n).over(Window.partitionBy()), 4)


@query("q3_4_agreement", "SELECT dx, count(*) AS n, count(*) FILTER (WHERE dx = by_score) AS agree, round(count(*) FILTER (WHERE dx = by_score) / count(*), 6) AS share FROM (SELECT dx, CASE WHEN mmse >= 27 THEN 'CN' WHEN mmse >= 21 THEN 'MCI' ELSE 'AD' END AS by_score FROM visits WHERE dx <> 'SMC') GROUP BY 1")
def q3_4(t):
    rows = t.visits.where("dx <> 'SMC'").withColumn("agree", F.col("dx") == clean.score_to_diagnosis(F.col("mmse")))
    return rows.groupBy("dx").agg(F.count("*").alias("n"), F.count_if("agree").alias("agree"), F.round(F.count_if("agree") / F.count("*"), 6).alias("share"))


@query("q4_2_atn_groups", "SELECT profile, count(*) AS patients, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM (SELECT pid, concat('A', CASE WHEN min(value) FILTER (WHERE analyte = 'ABETA42') < 8 THEN '+' ELSE '-' END, 'T', CASE WHEN max(value) FILTER (WHERE analyte = 'PTAU') > 45 THEN '+' ELSE '-' END, 'N', CASE WHEN max(value) FILTER (WHERE analyte = 'TAU') > 45 THEN '+' ELSE '-' END) AS profile FROM facts GROUP BY 1) GROUP BY 1")
def q4_2(t):
    at = lambda analyte, f: f(F.when(F.col("analyte") == analyte, F.col("value")))
    sign = lambda letter, hit: F.concat(F.lit(letter), F.when(hit, "+").otherwise("-"))
    rows = t.facts.groupBy("pid").agg(F.concat(sign("A", at("ABETA42", F.min) < 8), sign("T", at("PTAU", F.max) > 45), sign("N", at("TAU", F.max) > 45)).alias("profile"))
    return rows.groupBy("profile").agg(F.count("*").alias("patients")).withColumn("pct", _share("patients"))


@query("q5_1_test_use", "SELECT line AS test, count(*) AS n, count(DISTINCT pid) AS patients, round(count(*) / count(DISTINCT pid), 6) AS a_patient FROM facts GROUP BY 1")
def q5_1(t):
    one = t.facts.groupBy(F.col("line").alias("test")).agg(F.count("*").alias("n"), F.count_distinct("pid").alias("patients"))
    return one.withColumn("a_patient", F.round(F.col("n") / F.col("patients"), 6))


@query("q6_1_family_history", "SELECT members, count(*) AS patients, sum(ill)::bigint AS with_dementia FROM (SELECT p.pid, count(v.vid) AS members, (count(*) FILTER (WHERE dx = 'AD') > 0)::int AS ill FROM patients p LEFT JOIN visits v ON v.pid = p.pid AND v.status = 'P' GROUP BY 1) GROUP BY 1")
def q6_1(t):
    """Visits of status P stand for family members."""
    members = t.visits.where("status = 'P'")
    rows = r.optional_counts(t.patients.select("pid"), "pid", {"members": members, "ill": members.where("dx = 'AD'")})
    return rows.groupBy(F.col("n_members").alias("members")).agg(F.count("*").alias("patients"), F.count_if(F.expr("n_ill > 0")).alias("with_dementia"))


@query("q7_1_modalities", "SELECT analyte AS modality, count(*) AS images, count(DISTINCT pid) AS patients, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM facts GROUP BY 1")
def q7_1(t):
    one = t.facts.groupBy(F.col("analyte").alias("modality")).agg(F.count("*").alias("images"), F.count_distinct("pid").alias("patients"))
    return one.withColumn("pct", _share("images"))


@query("q7_3_tracers", "SELECT tracer, count(*) AS n, count(DISTINCT pid) AS patients FROM (SELECT pid, CASE part % 5 WHEN 0 THEN 'FDG' WHEN 1 THEN 'AV45' WHEN 2 THEN 'PIB' WHEN 3 THEN 'AV1451' END AS tracer FROM facts) WHERE tracer IS NOT NULL GROUP BY 1")
def q7_3(t):
    series = F.expr("array('fdg scan', 'Florbetapir', 'pittsburgh compound', 'flortaucipir', 'localizer')[int(part % 5)]")
    rows = t.facts.select("pid", clean.pet_tracer(series).alias("tracer")).where("tracer is not null")
    return rows.groupBy("tracer").agg(F.count("*").alias("n"), F.count_distinct("pid").alias("patients"))


@query("q8_1_risk_profiles", "SELECT factors, count(*) AS patients FROM (SELECT p.pid, (genotype IS NOT NULL AND genotype LIKE '%4%')::int + (age > 75)::int + (pid IN (SELECT pid FROM visits WHERE dx = 'AD'))::int AS factors FROM patients p) GROUP BY 1")
def q8_1(t):
    found = p.risk_factors(t.patients, t.visits.select("pid", (F.col("dx") == "AD").alias("has_dementia")))
    return r.optional_counts(t.patients.select("pid"), "pid", {"f": found}).groupBy(F.col("n_f").cast("int").alias("factors")).agg(F.count("*").alias("patients"))


@query("q8_3_contributing", "SELECT factor, count(*) AS patients, count(*) FILTER (WHERE ad) AS with_ad, round(count(*) FILTER (WHERE ad) / count(*), 6) AS rate FROM (SELECT pid, 'APOE4' AS factor FROM patients WHERE genotype LIKE '%4%' UNION ALL SELECT pid, 'AGE' FROM patients WHERE age > 75) f JOIN (SELECT pid, bool_or(dx = 'AD') AS ad FROM visits GROUP BY 1) v USING (pid) GROUP BY 1")
def q8_3(t):
    outcome = t.visits.groupBy("pid").agg(F.bool_or(F.col("dx") == "AD").alias("ad"))
    none = t.visits.select("pid", F.lit(False).alias("has_dementia"))
    rows = p.risk_factors(t.patients, none).join(outcome, "pid")
    return rows.groupBy("factor").agg(F.count("*").alias("patients"), F.count_if("ad").alias("with_ad"), F.round(F.count_if("ad") / F.count("*"), 6).alias("rate"))


@query("q10_1_missing", "SELECT count(*) AS patients, count(*) FILTER (WHERE genotype IS NULL) AS no_genotype, count(*) FILTER (WHERE pid NOT IN (SELECT pid FROM visits)) AS no_visit, count(*) FILTER (WHERE pid NOT IN (SELECT pid FROM facts WHERE analyte = 'TAU')) AS no_tau FROM patients")
def q10_1(t):
    rows = r.optional_counts(t.patients.select("pid", "genotype"), "pid", {"v": t.visits, "tau": t.facts.where("analyte = 'TAU'")})
    return rows.agg(F.count("*").alias("patients"), F.count_if(F.expr("genotype is null")).alias("no_genotype"), F.count_if(F.expr("n_v = 0")).alias("no_visit"), F.count_if(F.expr("n_tau = 0")).alias("no_tau"))


@query("q10_3_out_of_order", "SELECT pid, vid, vdate, before FROM (SELECT pid, vid, vdate, lag(vdate) OVER (PARTITION BY pid ORDER BY months, vid) AS before FROM visits) WHERE vdate < before")
def q10_3(t):
    w = Window.partitionBy("pid").orderBy("months", "vid")
    return t.visits.select("pid", "vid", "vdate", F.lag("vdate").over(w).alias("before")).where("vdate < before")


@query("q11_1_eligible", "SELECT p.pid, dx, mmse FROM patients p JOIN (SELECT pid, max_by(dx, months * 10000000 + vid) AS dx, max_by(mmse, months * 10000000 + vid) AS mmse FROM visits GROUP BY 1) v ON p.pid = v.pid WHERE age BETWEEN 55 AND 85 AND dx IN ('MCI', 'SMC') AND mmse BETWEEN 20 AND 28 AND p.pid IN (SELECT pid FROM facts WHERE analyte = 'ABETA42' AND value < 10)")
def q11_1(t):
    latest = r.pick(t.visits, ["pid"], [F.desc("months"), F.desc("vid")]).select("pid", "dx", "mmse")
    positive = t.facts.where("analyte = 'ABETA42' and value < 10").select("pid")
    return t.patients.where("age between 55 and 85").select("pid").join(latest.where("dx in ('MCI', 'SMC') and mmse between 20 and 28"), "pid").join(positive, "pid", "left_semi")


@query("q11_3_preclinical", "SELECT v.pid, count(DISTINCT analyte) AS markers, string_agg(DISTINCT analyte, ',' ORDER BY analyte) AS names FROM (SELECT pid FROM visits GROUP BY 1 HAVING bool_and(dx IN ('CN', 'SMC'))) v JOIN facts f ON f.pid = v.pid AND abnormal = 1 GROUP BY 1")
def q11_3(t):
    normal = t.visits.groupBy("pid").agg(F.bool_and(F.col("dx").isin("CN", "SMC")).alias("ok")).where("ok").select("pid")
    found = nested.overview(normal, "pid", {"markers": (t.facts.where("abnormal = 1"), "analyte")})
    return found.where("facts['markers'].n > 0").select("pid", F.size(F.col("facts")["markers"]["list"]).cast("long").alias("markers"), F.array_join(F.col("facts")["markers"]["list"], ",").alias("names"))


@query("q12_3_pathways", "SELECT path, count(*) AS patients FROM (SELECT pid, string_agg(dx, '>' ORDER BY months, vid) AS path FROM (SELECT *, lag(dx) OVER (PARTITION BY pid ORDER BY months, vid) AS b FROM visits) WHERE b IS NULL OR b <> dx GROUP BY 1) GROUP BY 1")
def q12_3(t):
    """Each patient's sequence of different diagnoses."""
    w = Window.partitionBy("pid").orderBy("months", "vid")
    turns = t.visits.withColumn("b", F.lag("dx").over(w)).where("b is null or b <> dx")
    path = turns.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("months", "vid", "dx"))).alias("s"))
    return path.groupBy(F.array_join(F.transform("s", lambda x: x["dx"]), ">").alias("path")).agg(F.count("*").alias("patients"))


@query("b1_3_atn_risk", "SELECT stage, count(*) AS patients, round(avg(age), 6) AS age FROM (SELECT f.pid, age, CASE p WHEN 'A+/T+/N+' THEN 'full_ad_pathology' WHEN 'A+/T+/N-' THEN 'ad_pathologic_change' WHEN 'A+/T-/N-' THEN 'preclinical_ad' WHEN 'A-/T+/N+' THEN 'non_ad_pathology' ELSE 'other' END AS stage FROM (SELECT pid, concat('A', CASE WHEN min(value) FILTER (WHERE analyte = 'ABETA42') < 5 THEN '+' ELSE '-' END, '/T', CASE WHEN max(value) FILTER (WHERE analyte = 'PTAU') > 47 THEN '+' ELSE '-' END, '/N', CASE WHEN max(value) FILTER (WHERE analyte = 'TAU') > 47 THEN '+' ELSE '-' END) AS p FROM facts GROUP BY 1) f JOIN patients q ON q.pid = f.pid) GROUP BY 1")
def b1_3(t):
    at = lambda analyte, f: f(F.when(F.col("analyte") == analyte, F.col("value")))
    sign = lambda letter, hit: F.concat(F.lit(letter), F.when(hit, "+").otherwise("-"))
    rows = t.facts.groupBy("pid").agg(p.atn_stage(F.concat_ws("/", sign("A", at("ABETA42", F.min) < 5), sign("T", at("PTAU", F.max) > 47), sign("N", at("TAU", F.max) > 47))).alias("stage"))
    return rows.join(t.patients.select("pid", "age"), "pid").groupBy("stage").agg(F.count("*").alias("patients"), F.round(F.avg("age"), 6).alias("age"))


@query("b2_2_survival_groups", "SELECT grp, count(*) AS patients, count(m) AS converted, round(avg(m), 6) AS months FROM (SELECT p.pid, CASE WHEN genotype LIKE '%E4%' AND n > 0 THEN 'carrier positive' WHEN genotype LIKE '%E4%' THEN 'carrier' WHEN n > 0 THEN 'positive' ELSE 'neither' END AS grp, m FROM patients p LEFT JOIN (SELECT pid, count(*) AS n FROM facts WHERE analyte = 'ABETA42' AND value < 8 GROUP BY 1) f ON p.pid = f.pid LEFT JOIN (SELECT pid, min(months) AS m FROM visits WHERE dx = 'AD' AND months > 0 GROUP BY 1) v ON p.pid = v.pid) GROUP BY 1")
def b2_2(t):
    positive = t.facts.where("analyte = 'ABETA42' and value < 8")
    rows = r.optional_counts(t.patients.select("pid", "genotype"), "pid", {"a": positive}).join(t.visits.where("dx = 'AD' and months > 0").groupBy("pid").agg(F.min("months").alias("m")), "pid", "left")
    carrier = F.coalesce(clean.count_allele(F.col("genotype")) > 0, F.lit(False))
    group = clean.cases([(carrier & (F.col("n_a") > 0), F.lit("carrier positive")), (carrier, F.lit("carrier")), (F.col("n_a") > 0, F.lit("positive"))], F.lit("neither"))
    return rows.groupBy(group.alias("grp")).agg(F.count("*").alias("patients"), F.count("m").alias("converted"), F.round(F.avg("m"), 6).alias("months"))


@query("b4_2_at_baseline", "SELECT dx, count(*) AS n, round(avg(tau), 6) AS tau, round(stddev_samp(tau), 6) AS tau_sd, round(avg(tau / nullif(abeta, 0)), 6) AS ratio FROM (SELECT v.vid, dx, avg(value) FILTER (WHERE analyte = 'TAU') AS tau, avg(value) FILTER (WHERE analyte = 'ABETA42') AS abeta FROM visits v JOIN facts f ON f.vid = v.vid WHERE v.months = 0 GROUP BY ALL) GROUP BY 1")
def b4_2(t):
    wide = t.facts.where("months = 0").groupBy("vid").pivot("analyte", ["TAU", "ABETA42"]).agg(F.avg("value"))
    rows = wide.join(t.visits.where("months = 0").select("vid", "dx"), "vid")
    return rows.groupBy("dx").agg(F.count("*").alias("n"), F.round(F.avg("TAU"), 6).alias("tau"), F.round(F.stddev_samp("TAU"), 6).alias("tau_sd"), F.round(F.avg(F.col("TAU") / F.nullif("ABETA42", F.lit(0.0))), 6).alias("ratio"))


@query("b5_2_combinations", "SELECT combination, count(*) AS patients, count(*) FILTER (WHERE ad) AS converted FROM (SELECT f.pid, string_agg(DISTINCT analyte, '+' ORDER BY analyte) AS combination, any_value(ad) AS ad FROM facts f JOIN (SELECT pid, bool_or(dx = 'AD') AS ad FROM visits GROUP BY 1) v ON f.pid = v.pid WHERE abnormal = 1 AND months = 0 GROUP BY 1) GROUP BY 1 HAVING count(*) >= 2")
def b5_2(t):
    outcome = t.visits.groupBy("pid").agg(F.bool_or(F.col("dx") == "AD").alias("ad"))
    found = nested.overview(outcome, "pid", {"m": (t.facts.where("abnormal = 1 and months = 0"), "analyte")}).where("facts['m'].n > 0")
    return found.groupBy(F.array_join(F.col("facts")["m"]["list"], "+").alias("combination")).agg(F.count("*").alias("patients"), F.count_if("ad").alias("converted")).where("patients >= 2")


@query("b5_4_early_signature", "SELECT analyte, count(*) FILTER (WHERE conv) AS converters, count(*) FILTER (WHERE NOT conv) AS others, round(avg(value) FILTER (WHERE conv) - avg(value) FILTER (WHERE NOT conv), 6) AS gap FROM (SELECT f.analyte, value, m IS NOT NULL AS conv FROM facts f JOIN (SELECT pid FROM visits GROUP BY 1 HAVING min_by(dx, months * 10000000 + vid) IN ('CN', 'SMC')) s ON s.pid = f.pid LEFT JOIN (SELECT pid, min(months) AS m FROM visits WHERE dx = 'AD' GROUP BY 1) a ON a.pid = f.pid WHERE f.months = 0) GROUP BY 1")
def b5_4(t):
    start = t.visits.groupBy("pid").agg(F.min_by("dx", F.struct("months", "vid")).alias("first")).where("first in ('CN', 'SMC')").select("pid")
    event = t.visits.where("dx = 'AD'").select("pid").distinct().withColumn("conv", F.lit(True))
    rows = t.facts.where("months = 0").join(start, "pid", "left_semi").join(event, "pid", "left").withColumn("conv", F.coalesce("conv", F.lit(False)))
    mean = lambda yes: F.avg(F.when(F.col("conv") == yes, F.col("value")))
    return rows.groupBy("analyte").agg(F.count_if("conv").alias("converters"), F.count_if(~F.col("conv")).alias("others"), F.round(mean(True) - mean(False), 6).alias("gap"))


@query("x3_4_converters", "SELECT pid, first_month, ad_month, ad_month - first_month AS took FROM (SELECT pid, min(months) FILTER (WHERE dx = 'CN') AS first_month, min(months) FILTER (WHERE dx IN ('MCI', 'AD')) AS ad_month FROM visits GROUP BY 1) WHERE first_month < ad_month")
def x3_4(t):
    first = lambda *dx: F.min(F.when(F.col("dx").isin(*dx), F.col("months")))
    rows = t.visits.groupBy("pid").agg(first("CN").alias("first_month"), first("MCI", "AD").alias("ad_month")).where("first_month < ad_month")
    return rows.withColumn("took", F.col("ad_month") - F.col("first_month"))


@query("x5_2_by_diagnosis", "SELECT dx, analyte, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM facts f JOIN (SELECT vid, dx FROM visits) v ON f.vid = v.vid GROUP BY ALL HAVING count(*) >= 5")
def x5_2(t):
    rows = t.facts.join(t.visits.select("vid", "dx"), "vid")
    return rows.groupBy("dx", "analyte").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd")).where("n >= 5")


@query("x7_3_family_risk", "SELECT CASE WHEN n = 0 THEN 'none' WHEN n < 3 THEN 'some' ELSE 'many' END AS risk, count(*) AS patients, round(avg(age), 6) AS age FROM (SELECT p.pid, age, count(v.vid) AS n FROM patients p LEFT JOIN visits v ON v.pid = p.pid AND dx = 'AD' GROUP BY ALL) GROUP BY 1")
def x7_3(t):
    rows = r.optional_counts(t.patients.select("pid", "age"), "pid", {"ill": t.visits.where("dx = 'AD'")})
    return rows.groupBy(clean.cases([(F.col("n_ill") == 0, F.lit("none")), (F.col("n_ill") < 3, F.lit("some"))], F.lit("many")).alias("risk")).agg(F.count("*").alias("patients"), F.round(F.avg("age"), 6).alias("age"))


@query("x8_9_semantic_chain", "SELECT a.src AS patient, b.dst AS nation, c.dst AS region FROM edges a JOIN edges b ON a.src = b.src AND b.type = 'LIVES_IN' JOIN edges c ON c.src = b.dst AND c.type = 'IS_A' WHERE a.type = 'HAS_VISIT' GROUP BY ALL HAVING count(*) >= 12")
def x8_9(t):
    from strandline.operators.graph import chain

    busy = _n(t.edges.where("type = 'HAS_VISIT'"), F.col("src").alias("n0")).where("n >= 12").select("n0")
    return chain(t.edges, "LIVES_IN", "IS_A").join(busy, "n0", "left_semi").select(F.col("n0").alias("patient"), F.col("n1").alias("nation"), F.col("n2").alias("region"))


@query("x9_5_longest_follow_up", "SELECT pid, max(months) AS months, count(*) AS visits FROM visits GROUP BY 1 ORDER BY months DESC, pid LIMIT 20")
def x9_5(t):
    return t.visits.groupBy("pid").agg(F.max("months").alias("months"), F.count("*").alias("visits")).orderBy(F.desc("months"), "pid").limit(20)


@query("x10_2_degree_by_label", "SELECT label, count(*) AS nodes, round(avg(coalesce(d, 0)), 6) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) e ON e.id = n.id GROUP BY 1")
def x10_2(t):
    from strandline.operators.graph import degrees

    rows = t.nodes.select("id", "label").join(degrees(t.edges), "id", "left")
    return rows.groupBy("label").agg(F.count("*").alias("nodes"), F.round(F.avg(F.coalesce("degree", F.lit(0))), 6).alias("degree"))


@query("x11_3_all_three", "SELECT p.pid, v.n AS visits, f.n AS markers FROM patients p JOIN (SELECT pid, count(*) AS n FROM visits GROUP BY 1) v ON v.pid = p.pid JOIN (SELECT pid, count(DISTINCT analyte) AS n FROM facts GROUP BY 1) f ON f.pid = p.pid WHERE f.n >= 5 AND p.pid IN (SELECT pid FROM visits WHERE dx = 'AD')")
def x11_3(t):
    kinds = {"visits": (t.visits, None), "markers": (t.facts, "analyte"), "ill": (t.visits.where("dx = 'AD'"), None)}
    rows = nested.overview(t.patients.select("pid"), "pid", kinds)
    at = lambda k: F.col("facts")[k]
    return rows.select("pid", at("visits")["n"].alias("visits"), F.size(at("markers")["list"]).cast("long").alias("markers"), at("ill")["n"].alias("ill")).where("visits > 0 and markers >= 5 and ill > 0").drop("ill")


@query("x12_2_diagnosis_completeness", "SELECT status, count(*) AS visits, count(dxs) AS with_dx, count(score) AS with_score, round(100 * count(score) / count(*), 4) AS score_pct FROM (SELECT status, CASE WHEN dx <> 'SMC' THEN dx END AS dxs, CASE WHEN mmse > 0 THEN mmse END AS score FROM visits) GROUP BY 1")
def x12_2(t):
    rows = t.visits.select("status", F.expr("CASE WHEN dx <> 'SMC' THEN dx END").alias("dxs"), F.expr("CASE WHEN mmse > 0 THEN mmse END").alias("score"))
    return rows.groupBy("status").agg(F.count("*").alias("visits"), F.count("dxs").alias("with_dx"), F.count("score").alias("with_score"), F.round(100 * F.count("score") / F.count("*"), 4).alias("score_pct"))


@query("x12_3_without_visit", "SELECT segment, count(*) AS patients FROM patients WHERE pid NOT IN (SELECT pid FROM visits) GROUP BY 1")
def x12_3(t):
    return r.without(t.patients, t.visits, "pid").groupBy("segment").agg(F.count("*").alias("patients"))


@query("x3_5_progression_patterns", "SELECT first_dx, last_dx, count(*) AS patients, round(avg(m), 6) AS months FROM (SELECT pid, min_by(dx, months * 10000000 + vid) AS first_dx, max_by(dx, months * 10000000 + vid) AS last_dx, max(months) - min(months) AS m FROM visits GROUP BY 1 HAVING count(*) >= 2) GROUP BY ALL")
def x3_5(t):
    order = F.struct("months", "vid")
    rows = t.visits.groupBy("pid").agg(F.min_by("dx", order).alias("first_dx"), F.max_by("dx", order).alias("last_dx"), (F.max("months") - F.min("months")).alias("m"), F.count("*").alias("k")).where("k >= 2")
    return rows.groupBy("first_dx", "last_dx").agg(F.count("*").alias("patients"), F.round(F.avg("m"), 6).alias("months"))


@query("b3_4_similar_courses", "SELECT course, count(*) AS patients FROM (SELECT pid, CASE WHEN d <= -10 THEN 'steep' WHEN d < 0 THEN 'slow' WHEN d = 0 THEN 'level' ELSE 'rising' END AS course FROM (SELECT pid, max_by(mmse, months * 10000000 + vid) - min_by(mmse, months * 10000000 + vid) AS d FROM visits GROUP BY 1 HAVING count(*) >= 2)) GROUP BY 1")
def b3_4(t):
    order = F.struct("months", "vid")
    d = t.visits.groupBy("pid").agg((F.max_by("mmse", order) - F.min_by("mmse", order)).alias("d"), F.count("*").alias("k")).where("k >= 2")
    return d.groupBy(clean.cases([(F.col("d") <= -10, F.lit("steep")), (F.col("d") < 0, F.lit("slow")), (F.col("d") == 0, F.lit("level"))], F.lit("rising")).alias("course")).agg(F.count("*").alias("patients"))


@query("b2_1_time_to_progression", "SELECT cohort, count(*) AS patients, round(avg(m), 6) AS months FROM (SELECT pid, CASE WHEN max(value) FILTER (WHERE analyte = 'PTAU') > 45 THEN 'high' ELSE 'low' END AS cohort FROM facts GROUP BY 1) f JOIN (SELECT pid, min(months) AS m FROM visits WHERE dx = 'AD' AND months > 0 GROUP BY 1) v ON f.pid = v.pid GROUP BY 1")
def b2_1(t):
    level = t.facts.groupBy("pid").agg(F.when(F.max(F.when(F.col("analyte") == "PTAU", F.col("value"))) > 45, "high").otherwise("low").alias("cohort"))
    event = t.visits.where("dx = 'AD' and months > 0").groupBy("pid").agg(F.min("months").alias("m"))
    return level.join(event, "pid").groupBy("cohort").agg(F.count("*").alias("patients"), F.round(F.avg("m"), 6).alias("months"))


@query("x1_5_patterns", "SELECT a.label AS src_label, type, b.label AS dst_label, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY ALL")
def x1_5(t):
    from strandline.operators.graph import patterns

    return patterns(t.nodes, t.edges, 0)


@query("x2_6_cohorts", "SELECT cohort, count(*) AS patients FROM (SELECT pid, max_by(dx, CASE dx WHEN 'CN' THEN 0 WHEN 'SMC' THEN 1 WHEN 'EMCI' THEN 2 WHEN 'MCI' THEN 3 WHEN 'LMCI' THEN 4 ELSE 5 END) AS cohort FROM visits GROUP BY 1) GROUP BY 1")
def x2_6(t):
    return c.cohort_of(t.visits).groupBy("cohort").agg(F.count("*").alias("patients"))
