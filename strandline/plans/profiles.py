"""Queries over profiles, measures and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import arrays as a
from strandline.operators import clinical as c
from strandline.operators import profiles as p
from strandline.operators import relational as r
from strandline.plans.cohort import query
from strandline.sources import measures as m


def _vitals(t):
    return t.visits.select(
        F.col("pid").alias("PTID"), F.expr("concat('V', vid)").alias("VISCODE2"), F.expr("string(50 + mmse * 9)").alias("VSBPSYS"), F.expr("CASE WHEN vid % 5 = 0 THEN 'NA' ELSE '80' END").alias("VSBPDIA"), F.expr("100 + vid % 90").alias("VSWEIGHT"), F.expr("1 + vid % 2").alias("VSWTUNIT"),
        F.expr("60 + vid % 20").alias("VSHEIGHT"), F.lit(1).alias("VSHTUNIT"), F.expr("mmse * 8").alias("VSPULSE"),
    )


_VITALS = """v AS (SELECT vid, pid, mmse, CASE WHEN vid % 2 = 0 THEN round((100 + vid % 90) * 0.453592, 2) ELSE 100 + vid % 90 END::double AS w, round((60 + vid % 20) * 2.54, 2)::double AS h FROM visits), u AS (
    SELECT vid, pid, 'SystolicBP' AS type, '8480-6' AS code, (50 + mmse * 9)::double AS value, 60 AS lo, 260 AS hi FROM v UNION ALL SELECT vid, pid, 'DiastolicBP', '8462-4', CASE WHEN vid % 5 > 0 THEN 80 END, 30, 180 FROM v UNION ALL SELECT vid, pid, 'BodyWeight', '29463-7', w, 25, 250 FROM v UNION ALL SELECT vid, pid, 'BodyHeight', '8302-2', h, 100, 230 FROM v
    UNION ALL SELECT vid, pid, 'HeartRate', '8867-4', mmse * 8, 30, 220 FROM v UNION ALL SELECT vid, pid, 'BodyMassIndex', '39156-5', round(w / (h / 100 * (h / 100)), 2), 10, 80 FROM v)"""


@query("e11_six_vitals", f"WITH {_VITALS} SELECT concat(pid, '_v', vid, '_', type) AS biomarker_id, concat('LOINC:', code) AS curie, round(value, 1) AS value FROM u WHERE value BETWEEN lo AND hi AND vid % 3 > 0")
def e11_six(t):
    """Six vital signs of each visit that is known; a third of the visits isn't."""
    known = t.visits.where("vid % 3 > 0").select(F.expr("concat(pid, '_v', vid)").alias("visit_id"))
    rows, _ = m.vital_signs(_vitals(t), visits=known)
    return rows.select("biomarker_id", "curie", F.round("value", 1).alias("value"))


@query("e11_rejects", f"WITH {_VITALS} SELECT type, count(*) FILTER (WHERE value BETWEEN lo AND hi) AS kept, count(*) FILTER (WHERE NOT coalesce(value BETWEEN lo AND hi, false)) AS rejected FROM u GROUP BY 1")
def e11_rejects(t):
    return m.vital_signs(_vitals(t))[1]


@query("e12_comorbidities", "SELECT DISTINCT concat(pid, '_', c) AS comorbidity_id, concat('SNOMED-CT:', code) AS curie FROM (SELECT pid, 'cardiovascular' AS c, '49601007' AS code FROM visits WHERE mmse > 25 UNION ALL SELECT pid, 'renal', '42030000' FROM visits WHERE mmse < 3 UNION ALL SELECT pid, 'smoking_history', '77176002' FROM visits WHERE status = 'P')")
def e12_comorbidities(t):
    wide = t.visits.select(F.col("pid").alias("PTID"), F.expr("double(mmse > 25)").alias("MH4CARD"), F.expr("int(mmse < 3)").alias("MH12RENA"), F.expr("CASE WHEN status = 'P' THEN 'Y' ELSE 'N' END").alias("MH16SMOK"), F.lit(None).cast("string").alias("MHPSYCH"))
    return m.comorbidities(wide).select("comorbidity_id", "curie")


@query("e07_analytes", "SELECT concat('bio_', pid, '_v', vid, '_', analyte) AS biomarker_id, value, abnormal FROM (SELECT pid, vid, 'VITAMIN_B12' AS analyte, (mmse * 20)::double AS value, mmse * 20 < 200 AS abnormal FROM visits WHERE vid % 4 > 0 UNION ALL SELECT pid, vid, 'HOMOCYSTEINE', mmse, mmse > 15 FROM visits UNION ALL SELECT pid, vid, 'PTAU217', mmse / 10, false FROM visits)")
def e07_analytes(t):
    wide = t.visits.select(F.col("pid").alias("RID"), F.expr("concat('v', vid)").alias("VISCODE"), F.expr("CASE WHEN vid % 4 > 0 THEN string(mmse * 20) ELSE '--' END").alias("RCT11"), F.col("mmse").alias("HMT7"), F.expr("mmse / 10").alias("DILUTION_CORRECTED_CONC"))
    return m.analytes(wide, m.LABORATORY, "LABDATA").select("biomarker_id", "value", "abnormal")


@query("s05_has_diagnosis", "SELECT 'visits' AS name, count(*) AS n_rows, 9::int AS n_columns, count(DISTINCT pid) AS n_keys, true AS has_diagnosis, 'dx' AS diagnosis_columns FROM visits UNION ALL SELECT 'patients', count(*), 9, count(DISTINCT pid), false, '' FROM patients UNION ALL SELECT 'facts', count(*), 12, count(DISTINCT pid), false, '' FROM facts UNION ALL SELECT 'parts', count(*), 6, NULL, false, '' FROM part")
def s05_diagnosis(t):
    return m.profile_with_diagnoses({"visits": t.visits, "patients": t.patients, "facts": t.facts, "parts": t.part}, "pid")


@query("d11_levels", "SELECT pid, 'APOE4' AS factor, CASE WHEN genotype = 'E4/E4' THEN 'very_high' ELSE 'high' END AS level FROM patients WHERE genotype LIKE '%4%' UNION ALL SELECT pid, 'AGE', 'moderate' FROM patients WHERE age > 75 UNION ALL SELECT DISTINCT pid, 'FAMILY_HISTORY', 'moderate' FROM visits WHERE dx = 'AD' AND pid IN (SELECT pid FROM patients)")
def d11_levels(t):
    return p.risk_factors(t.patients.withColumn("genotype", F.expr("CASE WHEN genotype = 'E4/E4' THEN '4/4' ELSE genotype END")), t.visits.select("pid", (F.col("dx") == "AD").alias("has_dementia")))


@query("d12_eight_kinds", """WITH s AS (SELECT pid, max_by(CASE dx WHEN 'MCI' THEN 'EMCI' ELSE dx END, months * 10000000 + vid) AS stage FROM visits GROUP BY 1), a AS (SELECT pid, CASE WHEN bool_or(value < 8) THEN 'A+' ELSE 'A-' END AS st FROM facts WHERE analyte = 'ABETA42' GROUP BY 1), c AS (SELECT pid, CASE WHEN max(mmse) - min(mmse) > 15 THEN 'declining' ELSE 'stable' END AS co FROM visits WHERE months > 12 GROUP BY 1)
    SELECT * FROM (SELECT s.pid, CASE WHEN stage = 'AD' AND st = 'A+' THEN 'typical_ad' WHEN stage = 'AD' AND st = 'A-' THEN 'snap' WHEN stage = 'EMCI' AND co = 'declining' THEN 'progressive_mci' WHEN stage = 'EMCI' AND co = 'stable' THEN 'stable_mci' WHEN stage = 'CN' AND st = 'A+' THEN 'preclinical_ad' WHEN stage = 'AD' THEN 'ad_unspecified' WHEN stage = 'EMCI' THEN 'mci_unspecified' WHEN stage = 'CN' THEN 'control' END AS phenotype, co IS NOT NULL AS has_course FROM s LEFT JOIN a ON s.pid = a.pid LEFT JOIN c ON s.pid = c.pid) WHERE phenotype IS NOT NULL""")  # fmt: skip
def d12_eight(t):
    stage = t.visits.groupBy("pid").agg(F.max_by(F.expr("CASE dx WHEN 'MCI' THEN 'EMCI' ELSE dx END"), F.struct("months", "vid")).alias("stage"))
    amyloid = t.facts.where("analyte = 'ABETA42'").groupBy("pid").agg(F.when(F.bool_or(F.col("value") < 8), "A+").otherwise("A-").alias("status"))
    course = t.visits.where("months > 12").groupBy("pid").agg(F.expr("CASE WHEN max(mmse) - min(mmse) > 15 THEN 'declining' ELSE 'stable' END").alias("course"))
    return p.phenotypes(stage, amyloid, course).select("pid", "phenotype", "has_course")


@query("d15_all_pathways", """SELECT DISTINCT fid::varchar AS id, pathway, CASE WHEN abnormal = 1 THEN 0.9 ELSE 0.3 END::double AS strength FROM facts JOIN (VALUES ('ABETA42', 'amyloid_cascade'), ('ABETA40', 'amyloid_cascade'), ('TAU', 'tau_pathology'), ('TAU', 'neurodegeneration'), ('PTAU', 'tau_pathology')) r(a, pathway) ON analyte = a
    UNION ALL SELECT p_partkey::varchar, CASE p_partkey % 3 WHEN 0 THEN 'amyloid_cascade' ELSE 'neurodegeneration' END, NULL FROM part WHERE p_partkey % 3 < 2""")  # fmt: skip
def d15_all(t):
    images = t.part.select(F.col("p_partkey").alias("image_id"), F.expr("array('AV45', 'FDG', 'none')[p_partkey % 3]").alias("tracer"))
    return p.pathway_links(t.facts, "fid", images)


@query("d20_findings_and_edges", "SELECT 'finding' AS kind, count(*) AS n, round(sum(c), 6)::double AS confidence FROM (SELECT DISTINCT vid, CASE WHEN mmse > 10 THEN 0.75 ELSE 1.0 END AS c FROM visits) UNION ALL SELECT 'IS_CLINICAL_FINDING', count(*), NULL FROM visits UNION ALL SELECT 'HAS_CLINICAL_FINDING', count(*), NULL FROM visits WHERE pid % 2 = 0")
def d20_findings(t):
    rows = t.visits.select(F.concat(F.lit("dx_"), "vid").alias("diagnosis_id"), F.col("pid").alias("ptid"), F.col("dx").alias("code"), F.col("dx").alias("text"), F.expr("CASE WHEN mmse > 10 THEN 0.75 END").alias("confidence"))
    findings, edges = p.diagnosis_findings(rows.unionByName(rows), t.patients.where("pid % 2 = 0").select(F.col("pid").alias("ptid")))
    count = findings.agg(F.lit("finding").alias("kind"), F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))
    return count.unionByName(edges.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).withColumn("confidence", F.lit(None).cast("double")))


@query("d22_types_and_edges", "SELECT name, count(DISTINCT fid) AS n FROM (SELECT analyte AS name, fid FROM facts WHERE part % 5 > 0) GROUP BY 1")
def d22_types(t):
    types, edges = p.test_types(t.facts.select(F.col("fid").alias("id"), F.expr("CASE WHEN part % 5 > 0 THEN analyte END").alias("test_name")))
    return types.join(edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n")), "name")


@query("v05_stages", "SELECT DISTINCT concat(pid, '_atn_transition_', stage) AS event_id, stage FROM (SELECT pid, CASE p WHEN 'A+/T+/N+' THEN 'full_ad_pathology' WHEN 'A+/T+/N-' THEN 'ad_pathologic_change' WHEN 'A+/T-/N-' THEN 'preclinical_ad' WHEN 'A-/T+/N+' THEN 'non_ad_pathology' ELSE 'other' END AS stage FROM (SELECT pid, concat('A', CASE WHEN min(value) FILTER (WHERE analyte = 'ABETA42') < 8 THEN '+' ELSE '-' END, '/T', CASE WHEN max(value) FILTER (WHERE analyte = 'PTAU') > 40 THEN '+' ELSE '-' END, '/N', CASE WHEN max(value) FILTER (WHERE analyte = 'TAU') > 40 THEN '+' ELSE '-' END) AS p FROM facts GROUP BY pid, vid))")
def v05_stages(t):
    at = lambda analyte, f: f(F.when(F.col("analyte") == analyte, F.col("value")))
    sign = lambda letter, hit: F.concat(F.lit(letter), F.when(hit, "+").otherwise("-"))
    rows = t.facts.groupBy(F.col("pid").alias("ptid"), "vid").agg(F.concat_ws("/", sign("A", at("ABETA42", F.min) < 8), sign("T", at("PTAU", F.max) > 40), sign("N", at("TAU", F.max) > 40)).alias("profile"))
    return p.atn_events(rows).select("event_id", "stage")


@query("v17_categories", "SELECT category, count(*) AS n FROM (SELECT CASE event_id % 7 WHEN 0 THEN 'clinical' WHEN 1 THEN 'clinical' WHEN 2 THEN 'biomarker' WHEN 3 THEN 'cognitive' WHEN 4 THEN 'imaging' WHEN 5 THEN 'treatment' ELSE 'other' END AS category FROM events) GROUP BY 1")
def v17_categories(t):
    kind = F.expr("array('DIAGNOSIS_CHANGE', 'MCI_CONVERSION', 'ATN_TRANSITION', 'COGNITIVE_DECLINE', 'IMAGING_STUDY', 'TREATMENT', 'login')[event_id % 7]")
    return t.events.select(p.event_category(kind).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("v15_weighted_lags", """WITH e AS (SELECT pid, fid AS id, 'abnormal' AS kind, months FROM facts WHERE abnormal = 1 AND analyte = 'TAU' UNION ALL SELECT pid, vid, 'diagnosis', months FROM visits WHERE dx = 'AD' UNION ALL SELECT pid, fid, 'atrophy', months FROM facts WHERE analyte = 'NFL' AND value > 45), r AS (SELECT 'abnormal' AS c, 'diagnosis' AS f, 0.7 AS w UNION ALL SELECT 'atrophy', 'diagnosis', 0.6),
    x AS (SELECT y.pid, y.id AS effect_id, w, c, y.months - max(z.months) AS lag FROM e y JOIN r ON y.kind = f JOIN e z ON z.kind = c AND z.pid = y.pid AND z.months < y.months GROUP BY y.pid, y.id, y.months, w, c) SELECT c AS cause, w::double AS weight, count(*) AS n, sum(lag)::bigint AS lags FROM x GROUP BY ALL""")  # fmt: skip
def v15_lags(t):
    fact = lambda where, kind: t.facts.where(where).select(F.col("pid").alias("ptid"), F.col("fid").alias("id"), F.lit(kind).alias("kind"), "months")
    events = fact("abnormal = 1 and analyte = 'TAU'", "abnormal").unionByName(fact("analyte = 'NFL' and value > 45", "atrophy")).unionByName(t.visits.where("dx = 'AD'").select(F.col("pid").alias("ptid"), F.col("vid").alias("id"), F.lit("diagnosis").alias("kind"), "months"))
    found = p.precedence(events, [("abnormal", "diagnosis", 0.7), ("atrophy", "diagnosis", 0.6)])
    return found.groupBy(F.substring_index("rule", "->", 1).alias("cause"), "weight").agg(F.count("*").alias("n"), F.sum("lag").cast("long").alias("lags"))


@query("m02_all_sources", "WITH c AS (SELECT concat('P', p_partkey) AS id, concat('s', p_size % 4) AS source FROM part), h AS (SELECT DISTINCT source, fid FROM facts JOIN c ON concat('P', part) = id WHERE line < 3) SELECT s.source, coalesce(k, 0) AS concepts, coalesce(n, 0) AS grounded, round(n / k, 6) AS ratio FROM (SELECT unnest(['s0', 's1', 's2', 's9']) AS source) s LEFT JOIN (SELECT source, count(*) AS k FROM c GROUP BY 1) a ON s.source = a.source LEFT JOIN (SELECT source, count(*) AS n FROM h GROUP BY 1) b ON s.source = b.source")
def m02_all(t):
    concepts = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.expr("concat('s', p_size % 4)").alias("source"))
    edges = t.facts.select(F.concat(F.lit("F"), "fid").alias("src"), F.expr("array('MAPS_TO', 'MAPS_TO', 'OTHER')[int(least(line, 3)) - 1]").alias("type"), F.concat(F.lit("P"), "part").alias("dst"))
    return p.grounded_instances(concepts, edges, ["MAPS_TO", "CLASSIFIED_AS"], ["s0", "s1", "s2", "s9"])


@query("m06_of_parts", "SELECT category, count(*) AS total, count(k) AS matched, count(*) FILTER (WHERE s) AS strong, round(count(*) FILTER (WHERE s) / count(*), 6) AS share FROM (SELECT c.category, k, coalesce(s, false) AS s FROM (SELECT p_partkey, p_brand AS category FROM part UNION ALL SELECT p_partkey, NULL FROM part) c LEFT JOIN (SELECT part, count(*) AS k, bool_or(line = 1) AS s FROM facts WHERE abnormal = 1 GROUP BY 1) f ON p_partkey = part) GROUP BY 1")
def m06_parts(t):
    edges = t.facts.where("abnormal = 1").select(F.col("part").alias("src"), F.expr("CASE WHEN line = 1 THEN 'SAME_AS' ELSE 'RELATED' END").alias("type"))
    return p.alignment(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category")), edges)


@query("m19_report", """WITH e AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part WHERE p_partkey % 3 < 2), k AS (SELECT p_partkey + 1 AS a, p_partkey AS b FROM part WHERE p_partkey % 3 = 0) SELECT 'orphaned_members' AS check, count(*) AS n FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'one_way_parents', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = e.b AND k.b = e.a) UNION ALL SELECT 'circular_paths', (SELECT count(*) FROM part WHERE p_partkey % 3 = 2)
    UNION ALL SELECT 'members_with', count(*) FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'members_without', count(*) FROM part WHERE p_size % 3 = 1 UNION ALL SELECT 'members_unknown', count(*) FROM part WHERE p_size % 3 = 2""")  # fmt: skip
def m19_report(t):
    """Triples of parts as a family: two steps up and, at their ends, one back, which closes a circle."""
    members = t.part.select(F.col("p_partkey").alias("id"), F.expr("p_partkey % 5").alias("ptid"), F.expr("CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("has_dementia"))
    patients = t.spark.range(1, 5).select(F.col("id").alias("ptid"))
    edge = lambda rows, src, kind, dst: rows.select(F.expr(src).alias("src"), F.lit(kind).alias("type"), F.expr(dst).alias("dst"))
    up, back = t.part.where("p_partkey % 3 < 2"), t.part.where("p_partkey % 3 = 2")
    edges = edge(up, "p_partkey", "HAS_PARENT", "p_partkey + 1").unionByName(edge(t.part.where("p_partkey % 3 = 0"), "p_partkey + 1", "HAS_CHILD", "p_partkey")).unionByName(edge(back, "p_partkey", "HAS_PARENT", "p_partkey - 2")).unionByName(edge(back, "p_partkey - 2", "HAS_CHILD", "p_partkey"))
    return p.family_report(members, patients, edges)


@query("m20_measures", "SELECT 'total' AS measure, count(*)::double AS value FROM visits UNION ALL SELECT 'success_rate', round(avg((status = 'F')::int), 6) FROM visits UNION ALL SELECT 'has_tiff', round(avg((mmse > 10)::int), 6) FROM visits UNION ALL SELECT 'has_png', round(avg((months > 12)::int), 6) FROM visits UNION ALL SELECT concat('status_', coalesce(CASE WHEN status <> 'P' THEN status END, 'unknown')), count(*) FROM visits GROUP BY 1")
def m20_measures(t):
    rows = t.visits.select(F.expr("CASE WHEN status <> 'P' THEN status END").alias("status"), F.expr("mmse > 10").alias("tiff"), F.expr("months > 12").alias("png"))
    return p.processing_report(rows, ["tiff", "png"], done="F")


_RESULTS = "SELECT status AS modality, CASE WHEN mmse < 5 THEN ['File not found', 'pixel mismatch'] WHEN mmse = 7 THEN ['odd'] ELSE [] END AS errors, CASE WHEN price < 50000 THEN ['thumbnail missing'] END AS warnings, mmse > 3 AS metadata, price > 100000 AS tiff FROM visits"


def _results(t):
    return t.visits.select(F.col("status").alias("modality"), F.expr("CASE WHEN mmse < 5 THEN array('File not found', 'pixel mismatch') WHEN mmse = 7 THEN array('odd') ELSE array() END").cast("array<string>").alias("errors"), F.expr("CASE WHEN price < 50000 THEN array('thumbnail missing') END").alias("warnings"), F.expr("mmse > 3").alias("metadata"), F.expr("price > 100000").alias("tiff"))


@query("m22_by_modality", f"WITH r AS ({_RESULTS}), g AS (SELECT *, false AS is_all FROM r UNION ALL SELECT * REPLACE (NULL AS modality), true FROM r) SELECT modality, is_all, count(*) AS total, count(*) FILTER (WHERE len(errors) = 0 AND warnings IS NULL) AS passed, count(*) FILTER (WHERE len(errors) = 0 AND warnings IS NOT NULL) AS warned, count(*) FILTER (WHERE len(errors) > 0) AS failed, round(100 * avg(metadata::int), 6) AS metadata, round(100 * avg(tiff::int), 6) AS tiff FROM g GROUP BY ALL")
def m22_modality(t):
    return p.validation_report(_results(t), ["metadata", "tiff"])


@query("m22_issues", f"WITH r AS ({_RESULTS}), u AS (SELECT unnest(errors) AS m FROM r), i AS (SELECT 'error' AS severity, CASE m WHEN 'File not found' THEN 'FILE_NOT_FOUND' WHEN 'pixel mismatch' THEN 'PIXEL_VALIDATION_ERROR' ELSE 'UNKNOWN_ERROR' END AS type FROM u UNION ALL SELECT 'warning', 'THUMBNAIL_ISSUE' FROM r WHERE warnings IS NOT NULL) SELECT severity, type, n, round(100 * n / t, 6) AS pct, n > CASE severity WHEN 'error' THEN 0.1 ELSE 0.2 END * t AS notable FROM (SELECT severity, type, count(*) AS n FROM i GROUP BY ALL), (SELECT count(*) AS t FROM r)")
def m22_issues(t):
    return p.issue_report(_results(t))


@query("r06_by_criteria", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 500 AND 3000 AND source = (SELECT min(source) FROM documents)")
def r06_criteria(t):
    images = t.documents.select("doc_id", F.col("source").alias("ptid"), F.md5("text").alias("hash"), "lang", "n_chars")
    return p.look_up(images, patient=t.documents.agg(F.min("source")).first()[0], lang=["en", "de"], n_chars=(500, 3000)).select("doc_id")


@query("n06_five_regions", """WITH v AS (SELECT vec_id, unnest(embedding)::double AS v, unnest(range(len(embedding))) AS k FROM embeddings), g AS (SELECT vec_id, v, k // 8 AS y, k % 8 AS x FROM v), s AS (SELECT vec_id, stddev_pop(v) FILTER (WHERE x IN (3, 4) AND y IN (3, 4)) AS a, stddev_pop(v) FILTER (WHERE x IN (1, 2) AND y IN (1, 2)) AS b, stddev_pop(v) FILTER (WHERE x IN (5, 6) AND y IN (1, 2)) AS c, stddev_pop(v) FILTER (WHERE x IN (1, 2) AND y IN (5, 6)) AS d, stddev_pop(v) FILTER (WHERE x IN (5, 6) AND y IN (5, 6)) AS e,
    avg(v) FILTER (WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5) AS m, stddev_pop(v) FILTER (WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5) AS u FROM g GROUP BY 1) SELECT vec_id, round((a + b + c + d + e) / 5, 6) AS noise, round(m, 6) AS brightness, round(u, 6) AS uniformity FROM s""")  # fmt: skip
def n06_five(t):
    rows = p.roi_quality(t.embeddings.select("vec_id", a.doubles(F.col("embedding")).alias("v")), "vec_id", "v", 8, 8)
    return rows.select("vec_id", *[F.round(c, 6).alias(c) for c in ("noise", "brightness", "uniformity")])


@query("n09_rates", "SELECT vec_id % 3 AS format, count(*) AS n, CASE vec_id % 3 WHEN 1 THEN 0.0 ELSE 100.0 END::double AS range_kept_pct, CASE vec_id % 3 WHEN 1 THEN 0.0 ELSE 100.0 END::double AS values_kept_pct FROM embeddings GROUP BY ALL")
def n09_rates(t):
    """Copies that are shifted, stretched hundredfold, or equal."""
    rows = t.embeddings.select(F.expr("vec_id % 3").alias("format"), a.doubles(F.col("embedding")).alias("a"), F.lit(1.0).alias("psnr"), F.lit(0.0).alias("mse")).withColumn("b", F.expr("transform(a, v -> CASE format WHEN 0 THEN v + 5 WHEN 1 THEN v * 100 ELSE v END)"))
    return p.preservation_report(rows, "format").select("format", "n", "range_kept_pct", "values_kept_pct")


@query("d06_named_cohorts", "SELECT concat(lower(segment), '_', CASE WHEN genotype IS NULL THEN 'unknown' WHEN genotype LIKE '%E4%' THEN 'high' ELSE 'low' END, '_', CASE WHEN age > 70 THEN 'mri' ELSE 'none' END) AS cohort, count(*) AS size FROM patients GROUP BY 1 HAVING count(*) >= 2")
def d06_named(t):
    return p.research_cohorts(t.patients.select(F.col("segment").alias("group"), F.expr("CASE WHEN genotype LIKE '%E4%' THEN 'High' WHEN genotype IS NOT NULL THEN 'low' END").alias("risk"), F.expr("CASE WHEN age > 70 THEN 'MRI' ELSE 'none' END").alias("imaging")))


@query("d06_baseline", "SELECT cohort, count(*) AS n FROM (SELECT pid, CASE WHEN m >= 27 THEN 'normal' WHEN m >= 21 THEN 'mild' ELSE 'impaired' END AS cohort FROM (SELECT pid, min_by(mmse, months * 10000000 + vid) AS m FROM visits WHERE mmse > 2 GROUP BY 1)) GROUP BY 1")
def d06_baseline(t):
    return p.baseline_cohorts(t.visits.withColumn("mmse", F.expr("CASE WHEN mmse > 2 THEN mmse END"))).groupBy("cohort").agg(F.count("*").alias("n"))


@query("j11_band_counts", "SELECT pid, (SELECT count(*) FROM patients b WHERE b.genotype = a.genotype AND b.pid <> a.pid AND b.acctbal BETWEEN a.acctbal - 25 AND a.acctbal + 25) AS near FROM patients a WHERE genotype IS NOT NULL")
def j11_counts(t):
    return r.band_counts(t.patients, "genotype", "acctbal", "pid", 25.0).select("pid", "near")


@query("d31_four_maps", "SELECT pid::varchar AS patient, concat('AGE=', max(months), ' GENDER=', any_value(CASE WHEN pid % 2 = 0 THEN 'M' ELSE 'F' END)) AS demographic, concat('MMSE_SCORE=', max_by(mmse, months * 10000000 + vid)) AS assessment, 'MOTHDEM,MOTHER' AS family, 'price,status' AS clinical FROM (SELECT pid, months, vid, mmse FROM visits) GROUP BY pid")
def d31_four(t):
    """The visits as wide rows, a record a patient of each column's last value."""
    rows = t.visits.select(F.col("pid").alias("RID"), F.lit(" ").alias("PTID"), F.col("months").alias("AGE"), F.expr("CASE WHEN pid % 2 = 0 THEN ' M ' ELSE 'F' END").alias("GENDER"), F.col("mmse").alias("MMSE_SCORE"), F.lit("x").alias("MOTHER"), F.lit(1).alias("MOTHDEM_PARENT"), "price", "status", F.lit(None).cast("string").alias("DIAGNOSIS"), F.col("months").alias("_m"), F.col("vid").alias("_v"))
    found = c.patient_records(rows, ["_m", "_v"])
    keys = lambda m: F.array_join(F.filter(F.array_sort(F.map_keys(m)), lambda k: ~k.startswith("_")), ",")
    show = lambda m, *names: F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.col(m)[n]) for n in names])
    return found.select("patient", show("demographic", "AGE", "GENDER").alias("demographic"), show("assessment", "MMSE_SCORE").alias("assessment"), F.regexp_replace(keys("family_history"), "_PARENT", "").alias("family"), keys("clinical").alias("clinical"))


@query("d32_members", "SELECT patient, relation, has_dementia, onset, gender, count(*) AS n FROM (SELECT DISTINCT pid::varchar AS patient, 'parent' AS relation, dx = 'AD' AS has_dementia, CASE WHEN mmse > 5 THEN mmse + 50 END AS onset, 'F' AS gender, months FROM visits UNION ALL SELECT pid::varchar, 'sibling', CASE WHEN age > 70 THEN true WHEN age > 60 THEN false END, NULL, NULL, 0 FROM patients) GROUP BY ALL")
def d32_members(t):
    parents = t.visits.select(F.col("pid").alias("PTID"), F.expr("CASE WHEN dx = 'AD' THEN 1 ELSE 0 END").alias("HAS_DEMENTIA"), F.expr("CASE WHEN mmse > 5 THEN string(mmse + 50) ELSE 'unknown' END").alias("AGE_ONSET"), F.lit("F").alias("SEX"), "months")
    siblings = t.patients.select(F.lit("").alias("PTID"), F.col("pid").alias("RID"), F.expr("CASE WHEN age > 70 THEN 'yes' WHEN age > 60 THEN 'N' ELSE '?' END").alias("ALZHEIMER"))
    found = c.members_of_rows({"FAMHXPAR": parents, "visits": t.visits, "FAMILY_SIB": siblings})
    return found.groupBy("patient", "relation", "has_dementia", "onset", "gender").agg(F.count("*").alias("n"))


@query("d33_networks", "SELECT network, count(*) AS n FROM (SELECT CASE vid % 5 WHEN 0 THEN 'hippocampal' WHEN 1 THEN 'default_mode' WHEN 2 THEN 'hippocampal' WHEN 3 THEN 'default_mode' END AS network FROM visits) WHERE network IS NOT NULL GROUP BY 1")
def d33_networks(t):
    from strandline.functions.clean import anatomical_region

    text = F.expr("array('Hippo L', 'cortical', 'temporal', 'PARIETAL', 'whole')[vid % 5]")
    return t.visits.select(c.region_network(anatomical_region(text, F.lit("MRI"))).alias("network")).where("network is not null").groupBy("network").agg(F.count("*").alias("n"))


@query("a16_canonical", """WITH n AS (SELECT count(*) AS node_total, count(DISTINCT label) AS labels, count(uri) AS nodes_with_uri, count(*) FILTER (WHERE label = 'Patient') AS patients, count(*) FILTER (WHERE label = 'Visit' AND name = 'F') AS finished, round(count(uri) / count(*), 4) AS node_coverage FROM nodes), e AS (SELECT count(*) AS edge_total, count(DISTINCT type) AS types, count(uri) AS edges_with_uri, count(*) FILTER (WHERE type = 'IS_A') AS is_a, count(*) FILTER (WHERE uri LIKE '%biolink%') AS biolink, round(count(uri) / count(*), 4) AS edge_coverage FROM edges)
    SELECT *, (SELECT string_agg(concat(label, '=', n), ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM nodes GROUP BY 1)) AS by_label, (SELECT string_agg(concat(type, '=', n), ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM edges GROUP BY 1)) AS by_type FROM n, e""")  # fmt: skip
def a16_canonical(t):
    counts = {"patients": ("nodes", "label = 'Patient'"), "finished": ("nodes", "label = 'Visit' and name = 'F'"), "is_a": ("edges", "type = 'IS_A'"), "biolink": ("edges", "uri like '%biolink%'")}
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return c.canonical_snapshot(t.nodes, t.edges, counts).withColumns({"by_label": text("by_label"), "by_type": text("by_type")})


@query("g04_whole_graph", """WITH r AS (SELECT n_regionkey AS k, 1 + count(*) AS n, min('N:' || n_nationkey) AS component FROM nation GROUP BY 1), p AS (SELECT n_regionkey AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 9 GROUP BY 1), v AS (SELECT n_regionkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 9 GROUP BY 1), s AS (SELECT n_regionkey AS k, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT component, r.n + coalesce(p.n, 0) + coalesce(v.n, 0) + coalesce(s.n, 0) AS size FROM r LEFT JOIN p ON r.k = p.k LEFT JOIN v ON r.k = v.k LEFT JOIN s ON r.k = s.k UNION ALL SELECT 'P:' || o_custkey, 1 + count(*) FROM orders WHERE o_custkey % 10 = 9 GROUP BY o_custkey""")  # fmt: skip
def g04_whole(t):
    """Every component of the whole graph with its size."""
    from strandline.operators.graph import connected_components

    return connected_components(t.edges).groupBy("component").agg(F.count("*").alias("size"))


@query("e07_fluid_panel", "SELECT concat('bio_', pid, '_bl_', a) AS biomarker_id, value, CASE a WHEN 'Aβ42' THEN value < 1100 WHEN 'Total Tau' THEN value > 400 WHEN 'p-Tau181' THEN value > 27 ELSE false END AS abnormal FROM (SELECT pid, unnest(['Aβ42', 'Aβ40', 'Total Tau', 'p-Tau181']) AS a, unnest([age * 15, age, edu * 30, edu * 2])::double AS value FROM patients) UNION ALL SELECT concat('bio_', pid, '_APOE_bl'), CASE genotype WHEN 'E4/E4' THEN 12.0 WHEN 'E3/E4' THEN 3.0 WHEN 'E2/E4' THEN 2.5 WHEN 'E3/E3' THEN 1.0 ELSE 0.6 END::double, genotype LIKE '%E4%' FROM patients WHERE genotype IS NOT NULL")
def e07_fluid(t):
    panel = t.patients.select(F.col("pid").alias("PTID"), F.expr("age * 15").alias("ABETA42"), F.col("age").alias("ABETA40"), F.expr("edu * 30").alias("TAU"), F.expr("edu * 2").alias("PTAU"))
    genes = t.patients.select(F.col("pid").alias("PTID"), F.lit("").alias("VISCODE"), F.col("genotype").alias("GENOTYPE"))
    return m.analytes(panel, m.FLUID, "PANEL").unionByName(m.genotype_rows(genes, "GENES")).select("biomarker_id", "value", "abnormal")


@query("d26_ladder", "WITH s AS (SELECT pid, max(CASE WHEN mmse < 5 THEN 4 WHEN mmse < 10 THEN 3 WHEN mmse < 20 THEN 1 END) AS a FROM visits GROUP BY 1), f AS (SELECT DISTINCT pid FROM facts WHERE abnormal = 1 AND line = 7), r AS (SELECT coalesce(s.pid, f.pid) AS pid, coalesce(a, CASE WHEN f.pid IS NOT NULL THEN 0 END) AS r FROM s FULL JOIN f ON s.pid = f.pid) SELECT list_extract(['preclinical', 'mci', 'mild_ad', 'moderate_ad', 'severe_ad'], r + 1) AS stage, count(*) AS n FROM r WHERE r IS NOT NULL GROUP BY 1")
def d26_ladder(t):
    severity = F.expr("CASE WHEN mmse < 5 THEN 'severe_impairment' WHEN mmse < 10 THEN 'moderate_impairment' WHEN mmse < 20 THEN 'mild_impairment' ELSE 'none' END")
    found = p.current_stages(t.visits.select(F.col("pid").alias("ptid"), severity.alias("severity")), t.facts.where("line = 7").select(F.col("pid").alias("ptid"), F.expr("CASE WHEN abnormal = 1 THEN 'abnormal' END").alias("significance")))
    return found.groupBy("stage").agg(F.count("*").alias("n"))


@query("d26_atrophy", "SELECT i.pid AS ptid, region, modalities, n AS findings FROM (SELECT pid, CASE line WHEN 1 THEN 'hippocampus' WHEN 2 THEN 'cortex' END AS region, string_agg(DISTINCT analyte, ',' ORDER BY analyte) AS modalities FROM facts WHERE line < 3 GROUP BY ALL) i JOIN (SELECT pid, count(*) AS n FROM visits WHERE months <= 6 AND mmse > 5 GROUP BY 1) f ON i.pid = f.pid")
def d26_atrophy(t):
    images = t.facts.select(F.col("pid").alias("ptid"), F.expr("CASE line WHEN 1 THEN 'hippocampus' WHEN 2 THEN 'cortex' END").alias("region"), F.col("analyte").alias("modality"))
    findings = t.visits.select(F.col("pid").alias("ptid"), F.expr("CASE WHEN mmse > 5 THEN 'psychometric' ELSE 'other' END").alias("kind"), "months")
    return p.atrophy_links(images, findings).withColumn("modalities", F.array_join("modalities", ","))
