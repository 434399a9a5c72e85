"""Queries over the column functions (cleaning, codes, dates, bands)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import clean as c
from strandline.plans.cohort import query

_TOKEN = "CASE o_orderkey % 6 WHEN 0 THEN 'NA' WHEN 1 THEN '--' WHEN 2 THEN concat('$', o_totalprice) WHEN 3 THEN concat(o_totalprice, '%') WHEN 4 THEN '1,234.5' ELSE 'abc' END"
_CODE = "CASE o_orderkey % 8 WHEN 0 THEN 'bl' WHEN 1 THEN 'm06' WHEN 2 THEN 'month 18' WHEN 3 THEN 'y2' WHEN 4 THEN ' Screening' WHEN 5 THEN 'year3' WHEN 6 THEN 'uns1' ELSE '12' END"


@query("f01_clean_string", r"""SELECT doc_id, CASE WHEN length(s) > 100 THEN concat(substring(s, 1, 100), '...') ELSE s END AS cleaned
    FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x{0}\x{10000}-\x{10FFFF}]', '', 'g'), '^\s+|\s+$', '', 'g') AS s FROM documents)""")  # fmt: skip
def f01(t):
    return t.documents.select("doc_id", c.clean_string(F.col("text"), 100).alias("cleaned"))


@query("f02_clean_numeric", f"""SELECT o_orderkey AS id, try_cast(regexp_replace(x, '[,$%]', '', 'g') AS double) AS n FROM (SELECT o_orderkey, {_TOKEN} AS x FROM orders)""")
def f02(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), c.clean_numeric(F.expr(_TOKEN)).alias("n"))


_PID = "concat(CASE WHEN c_custkey % 9 = 0 THEN '381' ELSE lpad(cast(c_custkey % 100 AS varchar(9)), CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 3 END, '0') END, '_S_', lpad(cast(c_custkey AS varchar(9)), 4, '0'))"


@query("f03_valid_patient_id", f"""SELECT pid, regexp_full_match(pid, '\\d{{3}}_S_\\d{{4}}') AND NOT starts_with(pid, '381_S_') AS valid FROM (SELECT {_PID} AS pid FROM customer)""")
def f03(t):
    return t.customer.select(F.expr(_PID).alias("pid")).select("pid", c.valid_patient_id(F.col("pid")).alias("valid"))


@query("f04_f06_visit_codes", f"""SELECT id, code, v IN ('bl', 'sc', 'baseline', 'screening') OR starts_with(v, 'm') AS valid,
    CASE v WHEN 'month 18' THEN 'm18' WHEN 'screening' THEN 'sc' WHEN 'year3' THEN 'm36' ELSE v END AS normalized,
    cast(CASE v WHEN 'm06' THEN 6 WHEN 'month 18' THEN 18 WHEN 'y2' THEN 24 WHEN 'year3' THEN 3 WHEN 'uns1' THEN 1 WHEN '12' THEN 12 ELSE 0 END AS int) AS months
    FROM (SELECT id, code, lower(trim(code)) AS v FROM (SELECT o_orderkey AS id, {_CODE} AS code FROM orders))""")  # fmt: skip
def f04(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.expr(_CODE).alias("code"))
    v = F.col("code")
    return rows.select("id", "code", c.valid_visit_code(v).alias("valid"), c.normalize_viscode(v).alias("normalized"), c.viscode_to_months(v).alias("months"))


@query("f07_normalize_gender", """SELECT pid, CASE pid % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'M' WHEN 2 THEN 'F' WHEN 3 THEN 'F' END AS sex FROM patients""")
def f07(t):
    return t.patients.select("pid", c.normalize_gender(F.expr("CASE pid % 5 WHEN 0 THEN ' male' WHEN 1 THEN '1.0' WHEN 2 THEN 'female' WHEN 3 THEN '2' ELSE 'x' END")).alias("sex"))


@query("f08_derive_age", """SELECT vid, CASE WHEN a BETWEEN 40 AND 120 THEN a END AS age FROM (
    SELECT vid, CASE WHEN vid % 3 = 0 THEN cast(30 + vid % 50 AS int) ELSE cast(year(vdate) - (1900 + pid % 90) AS int) END AS a FROM visits)""")  # fmt: skip
def f08(t):
    given, born = F.expr("CASE WHEN vid % 3 = 0 THEN 30 + vid % 50 END"), F.expr("concat(CASE WHEN vid % 2 = 0 THEN '06/' ELSE '' END, 1900 + pid % 90)")
    return t.visits.select("vid", c.derive_age(given, F.col("vdate"), born).alias("age"))


@query("f09_f11_genotypes", """SELECT pid, concat('E', a, '/E', b) AS composed, cast((a = 4)::int + (b = 4)::int AS int) AS e4,
    CASE WHEN a = 4 AND b = 4 THEN 12.0 WHEN least(a, b) = 3 AND greatest(a, b) = 4 THEN 3.0 WHEN least(a, b) = 2 AND greatest(a, b) = 4 THEN 2.5 WHEN a = 3 AND b = 3 THEN 1.0 ELSE 0.6 END::double AS risk
    FROM (SELECT pid, 2 + pid % 3 AS a, 2 + nation % 3 AS b FROM patients)""")  # fmt: skip
def f09(t):
    g = c.compose_genotype(F.expr("2 + pid % 3"), F.expr("2 + nation % 3"))
    return t.patients.select("pid", g.alias("composed")).select("pid", "composed", c.count_allele(F.col("composed")).alias("e4"), c.genotype_risk(F.col("composed")).alias("risk"))


@query("f12_f14_diagnosis_codes", """SELECT vid, k AS dx, CASE k WHEN 'CN' THEN 'Cognitively Normal' WHEN 'MCI' THEN 'Mild Cognitive Impairment' WHEN 'AD' THEN 'Alzheimer''s Disease' WHEN 'SMC' THEN 'Subjective Memory Concern' END AS text,
    CASE WHEN dx = 'SMC' THEN 'SMC' WHEN dx = 'CN' THEN 'CN' WHEN dx = 'MCI' THEN 'EMCI' ELSE 'AD' END AS arm
    FROM (SELECT vid, dx, CASE vid % 5 WHEN 0 THEN 'CN' WHEN 1 THEN 'MCI' WHEN 2 THEN 'AD' WHEN 3 THEN dx END AS k FROM visits)""")  # fmt: skip
def f12(t):
    raw = F.expr("CASE vid % 5 WHEN 0 THEN ' normal' WHEN 1 THEN '2' WHEN 2 THEN 'Dementia' WHEN 3 THEN dx ELSE 'other' END")
    arm = F.expr("CASE WHEN dx = 'MCI' THEN 'group EMCI' ELSE concat(dx, ' arm') END")
    rows = t.visits.select("vid", c.map_diagnosis(raw).alias("dx"), c.map_arm(arm).alias("arm"))
    return rows.select("vid", "dx", c.lookup(F.col("dx"), c.DIAGNOSIS_TEXTS).alias("text"), "arm")


@query("f15_abnormal_flag", """SELECT analyte, count(*) AS n, count(*) FILTER (WHERE CASE analyte WHEN 'ABETA42' THEN value < 20 WHEN 'TAU' THEN value > 30 WHEN 'PTAU' THEN value > 10 ELSE false END) AS abnormal FROM facts GROUP BY analyte""")
def f15(t):
    rules = t.spark.createDataFrame([("ABETA42", 20.0, "low"), ("TAU", 30.0, "high"), ("PTAU", 10.0, "high")], "analyte string, threshold double, direction string")
    flagged = t.facts.join(F.broadcast(rules), "analyte", "left").withColumn("flag", c.abnormal_flag(F.col("value"), F.col("threshold"), F.col("direction")))
    return flagged.groupBy("analyte").agg(F.count("*").alias("n"), F.count_if("flag").alias("abnormal"))


@query("f16_f17_scores", """SELECT vid, CASE WHEN mmse >= 27 THEN 'normal' WHEN mmse >= 21 THEN 'mild_impairment' WHEN mmse >= 10 THEN 'moderate_impairment' ELSE 'severe_impairment' END AS mmse_band,
    CASE WHEN mmse <= 10 THEN 'normal' WHEN mmse <= 20 THEN 'mild_impairment' WHEN mmse <= 40 THEN 'moderate_impairment' ELSE 'severe_impairment' END AS adas_band,
    CASE WHEN mmse >= 27 THEN 'CN' WHEN mmse >= 21 THEN 'MCI' ELSE 'AD' END AS dx FROM visits""")  # fmt: skip
def f16(t):
    m = F.col("mmse")
    return t.visits.select("vid", c.interpret_score("MMSE", m).alias("mmse_band"), c.interpret_score("ADAS", m).alias("adas_band"), c.score_to_diagnosis(m).alias("dx"))


@query("f18_f19_family_columns", """SELECT pid, CASE pid % 5 WHEN 0 THEN 'mother' WHEN 1 THEN 'father' WHEN 2 THEN 'sibling' WHEN 3 THEN 'child' END AS relation, pid % 4 IN (0, 1) AS dementia FROM patients""")
def f18(t):
    name = F.expr("CASE pid % 5 WHEN 0 THEN 'MOTHDEM' WHEN 1 THEN 'FATHAGE' WHEN 2 THEN 'SIBALZ' WHEN 3 THEN 'CHILD1' ELSE 'RID' END")
    value = F.expr("CASE pid % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Alzheimer disease' WHEN 2 THEN 'no' END")
    return t.patients.select("pid", c.family_column(name).alias("relation"), c.indicates_dementia(value).alias("dementia"))


@query("f20_f21_vitals", """SELECT pid, round_even(w / (h * h), 2) AS bmi, CASE WHEN age BETWEEN 60 AND 80 THEN cast(age AS double) END AS pulse FROM (
    SELECT pid, age, (120 + pid % 90) * CASE WHEN pid % 2 = 0 THEN 0.453592 ELSE 1.0 END::double AS w, (60 + pid % 20) * CASE WHEN pid % 3 = 0 THEN 2.54 ELSE 2.0 END::double / 100 AS h FROM patients)""")  # fmt: skip
def f20(t):
    b = c.bmi(F.expr("double(120 + pid % 90)"), F.expr("pid % 2 = 0"), F.expr("double(60 + pid % 20) * CASE WHEN pid % 3 = 0 THEN 1D ELSE 2D END"), F.expr("pid % 3 = 0"))
    return t.patients.select("pid", b.alias("bmi"), c.in_range(F.col("age").cast("double"), 60, 80).alias("pulse"))


@query("f22_flag_truthy", """SELECT pid, pid % 4 IN (0, 2) AS flagged FROM patients""")
def f22(t):
    return t.patients.select("pid", c.flag_truthy(F.expr("CASE pid % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'y' ELSE 'n' END")).alias("flagged"))


@query("f23_f26_image_names", """SELECT vid, 'PET' AS modality, concat(a, '_scan') AS series, strftime(vdate, '%Y%m%d') AS study_date, CASE WHEN vid % 2 = 0 THEN 'AV45' ELSE 'FDG' END AS tracer,
    CASE WHEN vid % 2 = 0 THEN 'hippocampus' ELSE 'whole brain' END AS region, concat(lpad(cast(pid % 1000 AS varchar), 3, '0'), '_S_', lpad(cast(vid % 10000 AS varchar), 4, '0')) AS subject
    FROM (SELECT *, CASE WHEN vid % 2 = 0 THEN 'AV45' ELSE 'FDG' END AS a FROM visits)""")  # fmt: skip
def f23(t):
    name = F.expr("concat('PET_', CASE WHEN vid % 2 = 0 THEN 'AV45' ELSE 'FDG' END, '_scan_', date_format(vdate, 'yyyyMMdd'), '.dcm')")
    name = F.regexp_replace(name, r"_scan_(\d+)", "_scan_$1_1")
    path = F.expr("concat('/data/', lpad(string(pid % 1000), 3, '0'), '_S_', lpad(string(vid % 10000), 4, '0'), '/PET/x.dcm')")
    p = c.parse_image_name(name)
    series = F.regexp_replace(p["series"], r"_\d{8}$", "")
    return t.visits.select("vid", p["modality"].alias("modality"), series.alias("series"), p["study_date"].alias("study_date"), c.pet_tracer(name).alias("tracer"), c.region_of(F.expr("CASE WHEN vid % 2 = 0 THEN 'LHippoVol' ELSE 'ICV' END")).alias("region"), c.path_identity(path)["id"].alias("subject"))


@query("f27_f29_identifiers", r"""SELECT id, uri, CASE WHEN uri LIKE 'http://purl.obolibrary.org/obo/N_%' THEN replace(uri, 'http://purl.obolibrary.org/obo/N_', 'N:') END AS curie,
    CASE WHEN uri LIKE 'http://purl%' THEN 'OBO' WHEN uri LIKE 'cohort:%' THEN 'internal' END AS namespace FROM nodes""")  # fmt: skip
def f27(t):
    return t.nodes.select("id", "uri", c.normalize_curie(F.col("uri"), "N").alias("curie"), c.uri_namespace(F.col("uri")).alias("namespace"))


@query("f28_label_match", """SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name
    WHERE split_part(a.p_name, ' ', 1) IN (split_part(b.p_name, ' ', 1), split_part(b.p_name, ' ', 2)) OR split_part(a.p_name, ' ', 2) IN (split_part(b.p_name, ' ', 1), split_part(b.p_name, ' ', 2))""")  # fmt: skip
def f28(t):
    # the words that two labels share make the equi key, the function the residual
    names = t.part.select("p_name").distinct().withColumn("word", F.explode(F.split("p_name", " ")))
    pairs = names.select(F.col("p_name").alias("a"), "word").join(names.select(F.col("p_name").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    return pairs.where(c.label_match(F.col("a"), F.col("b")))


@query("f30_bucketize", """SELECT pid, CASE WHEN age < 65 THEN '<65' WHEN age < 75 THEN '65-74' WHEN age < 85 THEN '75-84' ELSE '85+' END AS age_group, cast(floor(age / 5) * 5 AS int) AS five FROM patients""")
def f30(t):
    return t.patients.select("pid", c.age_group(F.col("age")).alias("age_group"), c.bucket(F.col("age"), 5).alias("five"))


@query("f31_table_significance", """SELECT vid, CASE WHEN mmse >= 24 THEN 'none' WHEN mmse >= 18 THEN 'mild' ELSE 'severe' END AS severity FROM visits""")
def f31(t):
    return t.visits.select("vid", c.severity_of_scores(F.create_map(F.lit("MMSCORE_MMSE"), F.col("mmse"), F.lit("CDR"), F.lit(99))).alias("severity"))


@query("f32_parse_resolution", """SELECT pid, cast(greatest(100 + pid % 700, edu * 30) AS int) AS side FROM patients WHERE greatest(100 + pid % 700, edu * 30) >= 256""")
def f32(t):
    return t.patients.select("pid", c.largest_side(F.expr("concat(100 + pid % 700, 'X', edu * 30)")).alias("side")).where("side >= 256")


@query("f05_long_visits", """SELECT vid, CASE k WHEN 0 THEN concat('m', CASE WHEN n < 10 THEN '0' ELSE '' END, n) WHEN 1 THEN concat('m', 12 * (1 + n % 16)) WHEN 2 THEN concat('y', n) ELSE 'sc' END AS viscode, cast(CASE k WHEN 0 THEN n WHEN 1 THEN 12 * (1 + n % 16) WHEN 2 THEN 12 * n ELSE 0 END AS int) AS months
    FROM (SELECT vid, (vid // 4) % 193 AS n, vid % 4 AS k FROM visits)""")  # fmt: skip
def f05_long(t):
    """Months and years spelled out, also from 100 months on."""
    code = F.expr("CASE vid % 4 WHEN 0 THEN concat('Month ', vid div 4 % 193) WHEN 1 THEN concat('year', 1 + vid div 4 % 193 % 16) WHEN 2 THEN concat('Y', vid div 4 % 193) ELSE 'SCMRI' END")
    v = c.normalize_viscode(code)
    return t.visits.select("vid", v.alias("viscode"), c.viscode_to_months(v).alias("months"))


@query("f12_f17_number_codes", """SELECT fid, CASE WHEN v = 1 THEN 'CN' WHEN v = 2 THEN 'MCI' WHEN v = 3 THEN 'AD' END AS dx, CASE v WHEN 1 THEN 'CN' WHEN 2 THEN 'MCI' WHEN 3 THEN 'AD' WHEN 4 THEN 'MCI' WHEN 5 THEN 'AD' WHEN 6 THEN 'SMC' WHEN 7 THEN 'EMCI' WHEN 8 THEN 'LMCI' END AS dx8, CASE WHEN v = 0 THEN 'normal' WHEN v / 2 <= 0.5 THEN 'questionable' WHEN v / 2 <= 1 THEN 'mild' WHEN v / 2 <= 2 THEN 'moderate' ELSE 'severe' END AS cdr,
    CASE WHEN v = 0 THEN 'CN' WHEN v = 1 THEN 'MCI' ELSE 'AD' END AS by_cdr, CASE WHEN v = 0 THEN 'CN' ELSE 'AD' END AS second FROM (SELECT fid, part % 10 AS v FROM facts)""")  # fmt: skip
def f12_numbers(t):
    """Codes as they read from a float column, and CDR scores in halves."""
    code, cdr = F.expr("string(double(part % 10))"), F.expr("part % 10 / 2")
    return t.facts.select("fid", c.map_diagnosis(code).alias("dx"), c.map_diagnosis(code, c.DIAGNOSIS_NUMBERS_8).alias("dx8"), c.interpret_score("CDR", cdr).alias("cdr"), c.cdr_to_diagnosis(cdr).alias("by_cdr"), c.cdr_to_diagnosis_of_two(cdr).alias("second"))


@query("f18_family_names", """SELECT p_partkey, p % 6 IN (0, 1, 2, 3, 4) AND s % 3 <> 2 AS is_family, CASE p % 6 WHEN 0 THEN 'parent' WHEN 1 THEN 'parent' WHEN 2 THEN 'sibling' WHEN 3 THEN 'child' WHEN 4 THEN 'other_relative' ELSE 'unknown' END AS relation,
    CASE p % 6 WHEN 0 THEN 'F' WHEN 1 THEN 'M' WHEN 2 THEN 'F' WHEN 3 THEN 'F' END AS sex, CASE WHEN p % 6 = 1 OR s % 3 = 0 THEN 'Alzheimer''s Disease' END AS dementia FROM (SELECT p_partkey, p_partkey AS p, p_partkey // 6 AS s FROM part)""")  # fmt: skip
def f18_names(t):
    name = F.expr("concat(CASE p_partkey % 6 WHEN 0 THEN 'Mom' WHEN 1 THEN 'DAD' WHEN 2 THEN 'SISTER' WHEN 3 THEN 'DAUGHTER' WHEN 4 THEN 'FAMILY' ELSE 'RID' END, CASE p_partkey div 6 % 3 WHEN 0 THEN '_ALZH' WHEN 1 THEN '_AGE' ELSE '_X' END)")
    family = F.expr("p_partkey % 6 = 1") | c.is_family_column(name)  # DAD holds AD, so it is one by itself
    return t.part.select("p_partkey", F.when(F.expr("p_partkey div 6 % 3 = 2"), F.lit(False)).otherwise(family & F.expr("p_partkey % 6 <> 5")).alias("is_family"), c.family_relation(name).alias("relation"), c.relative_sex(name).alias("sex"), c.dementia_type(name).alias("dementia"))


@query("f21_range_counts", "SELECT name, count(*) FILTER (WHERE v BETWEEN lo AND hi) AS kept, count(*) FILTER (WHERE NOT v BETWEEN lo AND hi) AS rejected, count(*) FILTER (WHERE v IS NULL) AS missing FROM (SELECT 'pulse' AS name, 40 + mmse * 7 AS v, 30 AS lo, 220 AS hi FROM visits UNION ALL SELECT 'weight', CASE WHEN mmse > 2 THEN mmse * 10 END, 25, 250 FROM visits) GROUP BY 1")
def f21_counts(t):
    from strandline.sources.tables import range_check, range_counts

    rules = t.spark.createDataFrame([("pulse", 30.0, 220.0), ("weight", 25.0, 250.0)], "name string, low double, high double")
    rows = t.visits.selectExpr("stack(2, 'pulse', double(40 + mmse * 7), 'weight', double(CASE WHEN mmse > 2 THEN mmse * 10 END)) as (name, value)")
    return range_counts(range_check(rows, rules))


@query("f24_f25_series", """SELECT vid, CASE k WHEN 0 THEN 'FDG' WHEN 1 THEN 'AV45' WHEN 2 THEN 'MK6240' WHEN 3 THEN 'RO948' WHEN 4 THEN 'FDG' WHEN 5 THEN 'AV133' END AS tracer, CASE k WHEN 0 THEN 'hippocampus' WHEN 1 THEN 'cortex' WHEN 2 THEN 'temporal_lobe' WHEN 3 THEN 'cerebellum' WHEN 4 THEN 'whole_brain' WHEN 5 THEN 'ventricles' ELSE 'brain' END AS region FROM (SELECT vid, vid % 7 AS k FROM visits)""")
def f24_series(t):
    words = ["Fluorodeoxyglucose HIPPO", "AMYVID cortical", "MK6240 temporal", "ro-948 cerebellum", "metabolic whole", "AV133 ventricle", "localizer"]
    text = F.get(F.array(*map(F.lit, words)), F.expr("int(vid % 7)"))
    return t.visits.select("vid", c.pet_tracer(text).alias("tracer"), c.anatomical_region(text, F.lit("MRI")).alias("region"))


@query("f29_short_forms", "SELECT id, CASE k WHEN 0 THEN 'RO' WHEN 1 THEN 'Biolink' WHEN 2 THEN 'SKOS' WHEN 3 THEN 'RDFS' WHEN 4 THEN 'OWL' WHEN 5 THEN 'OWL-Time' WHEN 6 THEN 'Biolink' ELSE 'other' END AS namespace FROM (SELECT p_partkey AS id, p_partkey % 8 AS k FROM part)")
def f29_short(t):
    forms = ["ro:RO_0000056", "biolink:located_in", "skos:exactMatch", "rdfs:subClassOf", "owl:sameAs", "time:before", "http://w3id.org/biolink/x", "mesh:D1"]
    return t.part.select(F.col("p_partkey").alias("id"), c.uri_namespace(F.get(F.array(*map(F.lit, forms)), F.expr("int(p_partkey % 8)"))).alias("namespace"))


@query("f31_finding_significance", """SELECT fid, CASE line WHEN 1 THEN CASE WHEN mmse >= 24 THEN 'normal' WHEN mmse >= 20 THEN 'mild_impairment' WHEN mmse >= 10 THEN 'moderate_impairment' ELSE 'severe_impairment' END WHEN 2 THEN CASE WHEN value >= 10 THEN 'severe_impairment' WHEN value >= 4.5 THEN 'moderate_impairment' WHEN value >= 0.5 THEN 'mild_impairment' ELSE 'normal' END
    WHEN 3 THEN CASE WHEN analyte = 'ABETA42' OR (analyte = 'PTAU' AND value * 20 > 80) OR (analyte = 'TAU' AND value * 20 > 400) THEN CASE WHEN analyte = 'ABETA42' AND value * 20 >= 600 THEN 'normal' ELSE 'abnormal' END ELSE 'normal' END ELSE 'normal' END AS significance FROM facts f JOIN (SELECT vid, mmse FROM visits) v ON f.vid = v.vid""")  # fmt: skip
def f31_significance(t):
    rows = t.facts.join(t.visits.select("vid", "mmse"), "vid")
    kind = F.expr("CASE line WHEN 1 THEN 'psychometric' WHEN 2 THEN 'psychometric' WHEN 3 THEN 'biomarker' ELSE 'other' END")
    scores = F.expr("map_filter(map('MMSE score', double(mmse), 'CDR_SUM', CASE WHEN line = 2 THEN double(value) END), (k, v) -> v is not null)")
    none = F.lit(None).cast("map<string,string>")
    return rows.select("fid", c.finding_significance(kind, F.lit("csf_biomarker"), scores, F.create_map(F.col("analyte"), F.col("value") * 20), none).alias("significance"))
