"""Profiles, measures and report tables: nulls, repeats, empty tables, rules at their bounds."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import profiles
from strandline.sources import measures


def test_vital_signs(spark):
    rows = [("P1", "BL", "59", "80", "200", "1", "70", "1", "60"), ("P1", None, "120", None, None, None, None, None, None), (None, "m06", "120", "80", "70", "2", "170", "2", "60"), ("P2", "m06", "NA", "200", "70", "2", "170", "2", "x")]
    names = ["PTID", "VISCODE", "VSBPSYS", "VSBPDIA", "VSWEIGHT", "VSWTUNIT", "VSHEIGHT", "VSHTUNIT", "VSPULSE"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    found, counts = measures.vital_signs(df)
    got = {(r.ptid, r.type): (r.value, r.unit, r.visit_id) for r in found.collect()}
    assert got == {
        ("P1", "DiastolicBP"): (80.0, "mmHg", "P1_bl"), ("P1", "BodyWeight"): (90.72, "kg", "P1_bl"), ("P1", "BodyHeight"): (177.8, "cm", "P1_bl"), ("P1", "HeartRate"): (60.0, "bpm", "P1_bl"), ("P1", "BodyMassIndex"): (28.7, "kg/m^2", "P1_bl"),
        ("P2", "BodyWeight"): (70.0, "kg", "P2_m06"), ("P2", "BodyHeight"): (170.0, "cm", "P2_m06"), ("P2", "BodyMassIndex"): (24.22, "kg/m^2", "P2_m06"),
    }
    assert {r.type: (r.kept, r.rejected) for r in counts.collect()} == {"SystolicBP": (0, 2), "DiastolicBP": (1, 1), "BodyWeight": (2, 0), "BodyHeight": (2, 0), "HeartRate": (1, 1), "BodyMassIndex": (2, 0)}
    known = spark.createDataFrame([("P2_m06",), ("P2_m06",)], "visit_id string")
    assert measures.vital_signs(df, visits=known)[0].count() == 3
    assert measures.vital_signs(df.select("PTID", "VSBPSYS"))[0].count() == 0 and measures.vital_signs(df.limit(0))[1].count() == 0


def test_comorbidities_and_analytes(spark):
    df = spark.createDataFrame([("P", 1.0, "Y"), ("P", 1.0, "n"), ("Q", 2.0, " y "), (None, 1.0, "Y")], "PTID string, MHPSYCH double, MH12RENA string")
    assert sorted((r.ptid, r.category) for r in measures.comorbidities(df).collect()) == [("P", "psychiatric"), ("P", "renal"), ("Q", "renal")]
    assert measures.comorbidities(df.select("PTID")).count() == 0
    lab = spark.createDataFrame([("P", None, "199.9", "15"), (None, "m06", "x", "15.1")], "PTID string, VISCODE string, RCT11 string, HMT7 string").withColumn("RID", F.lit(7))
    got = {r.biomarker_id: (r.value, r.abnormal, r.unit) for r in measures.analytes(lab, measures.LABORATORY, "L").collect()}
    assert got == {"bio_P_bl_VITAMIN_B12": (199.9, True, "pg/mL"), "bio_P_bl_HOMOCYSTEINE": (15.0, False, "μmol/L"), "bio_7_m06_HOMOCYSTEINE": (15.1, True, "μmol/L")}
    assert measures.analytes(lab.select("PTID"), measures.LABORATORY, "L").count() == 0


def test_risks_phenotypes_and_pathways(spark):
    patients = spark.createDataFrame([(1, "E4/E4", 76), (2, "E3/E4", 75), (2, "E3/E4", 75), (3, None, None)], "pid int, genotype string, age int")
    members = spark.createDataFrame([(1, True), (1, True), (2, False), (3, None), (9, True)], "pid int, has_dementia boolean")
    assert sorted(tuple(r) for r in profiles.risk_factors(patients, members).collect()) == [(1, "AGE", "moderate"), (1, "APOE4", "very_high"), (1, "FAMILY_HISTORY", "moderate"), (2, "APOE4", "high")]
    cases = [("AD", "A+", None, "typical_ad"), ("AD", "A-", None, "snap"), ("AD", None, None, "ad_unspecified"), ("LMCI", "A+", "declining", "progressive_mci"), ("EMCI", None, "stable", "stable_mci"), ("EMCI", None, "up", "mci_unspecified"), ("CN", "A+", None, "preclinical_ad"), ("CN", "A-", "declining", "control"), ("SMC", "A+", None, None)]
    frame = lambda i, name: spark.createDataFrame([(k, c[i]) for k, c in enumerate(cases) if c[i]], f"pid int, {name} string")
    got = {r.pid: r.phenotype for r in profiles.phenotypes(frame(0, "stage"), frame(1, "status"), frame(2, "course")).collect()}
    assert got == {k: c[3] for k, c in enumerate(cases) if c[3]}
    facts = spark.createDataFrame([(1, "TAU", 1), (1, "TAU", 1), (2, "ABETA42", None), (3, "x", 1)], "fid int, analyte string, abnormal int")
    assert sorted(tuple(r) for r in profiles.pathway_links(facts, "fid").collect()) == [("1", "neurodegeneration", 0.9), ("1", "tau_pathology", 0.9), ("2", "amyloid_cascade", 0.3)]


def test_events_and_precedence(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "x string").select(f(F.col("x"))).first()[0]
    assert [one(profiles.event_category, v) for v in ("DIAGNOSIS_X", "ATN", "x", None)] == ["clinical", "biomarker", "other", None]
    assert [one(profiles.atn_stage, v) for v in ("A+/T+/N+", "A-/T-/N-", None)] == ["full_ad_pathology", "other", None]
    events = spark.createDataFrame([("p", 1, "c", 0), ("p", 2, "c", 5), ("p", 3, "c", 5), ("p", 4, "e", 5), ("p", 5, "e", 9), ("q", 6, "e", 1), (None, 7, "c", 0)], "ptid string, id int, kind string, months int")
    assert sorted((r.effect_id, r.cause_id, r.lag, r.weight) for r in profiles.precedence(events, [("c", "e", 0.7)]).collect()) == [(4, 1, 5, 0.7), (5, 3, 4, 0.7)]


def test_reports(spark):
    results = spark.createDataFrame([("a", ["File NOT found", None], None, True), (None, [], ["Missing metadata fields: x"], None), ("a", None, [], True)], "modality string, errors array<string>, warnings array<string>, ok boolean")
    got = {(r.modality, r.is_all): (r.total, r.passed, r.warned, r.failed, r.ok) for r in profiles.validation_report(results, ["ok"]).collect()}
    assert got == {("a", False): (2, 1, 0, 1, 100.0), (None, False): (1, 0, 1, 0, 0.0), (None, True): (3, 1, 1, 1, 66.666667)}
    issues = {r.type: (r.n, r.notable) for r in profiles.issue_report(results).collect()}
    assert issues == {"FILE_NOT_FOUND": (1, True), "INCOMPLETE_METADATA": (1, True)}
    assert profiles.validation_report(results.limit(0), ["ok"]).count() == 0
    concepts = spark.createDataFrame([("c1", "S"), ("c2", "S"), ("c2", "S"), ("c3", "T")], "id string, source string")
    edges = spark.createDataFrame([("n1", "MAPS_TO", "c1"), ("n1", "MAPS_TO", "c2"), ("c3", "MAPS_TO", "c1"), ("n2", "OTHER", "c3"), ("n3", "MAPS_TO", "gone")], "src string, type string, dst string")
    found = {r.source: (r.concepts, r.grounded, r.ratio) for r in profiles.grounded_instances(concepts, edges, ["MAPS_TO"], ["S", "T", "U"]).collect()}
    assert found == {"S": (2, 1, 0.5), "T": (1, 0, 0.0), "U": (0, 0, None)}
    aligned = {r.category: (r.total, r.matched, r.strong) for r in profiles.alignment(concepts.select("id", F.col("source").alias("category")), spark.createDataFrame([("c1", "SAME_AS"), ("c3", "x")], "src string, type string")).collect()}
    assert aligned == {"S": (2, 1, 1), "T": (1, 1, 0), None: (3, 2, 1)}
    images = spark.createDataFrame([("p", "h1", 5), ("p", "h2", 9), ("q", "h1", None)], "ptid string, hash string, n int")
    assert profiles.look_up(images).count() == 3 and profiles.look_up(images, "p", n=(6, None)).count() == 1 and profiles.look_up(images, digest="h1").count() == 2 and profiles.look_up(images, hash=["h1", "h2"], n=(None, 5)).count() == 1


def test_preservation_and_regions(spark):
    pairs = spark.createDataFrame([("x", [0.0, 10.0], [5.0, 15.2], 40.0, 1.0), ("x", [1.0, 1.0], [7.0, 7.0], float("inf"), 0.0), ("y", [0.0, 10.0], [0.0, 12.0], 20.0, 2.0)], "f string, a array<double>, b array<double>, psnr double, mse double")
    got = {r.f: (r.n, r.range_kept_pct, r.values_kept_pct, r.psnr, r.mse) for r in profiles.preservation_report(pairs, "f").collect()}
    assert got == {"x": (2, 100.0, 100.0, 40.0, 0.5), "y": (1, 0.0, 0.0, 20.0, 2.0)}
    image = spark.createDataFrame([(1, [float(i % 4) for i in range(16)])], "id int, v array<double>")
    r = profiles.roi_quality(image, "id", "v", 4, 4, size=2, central=2, distance=9).first()
    assert r.brightness == pytest.approx(1.5) and r.noise == pytest.approx(0.5) and r.uniformity == pytest.approx(0.5)


def test_band_counts_make_no_pairs(spark):
    from strandline.operators import relational

    rows = [(1, "a", 0.0), (2, "a", 0.0), (3, "a", 1.0), (4, "a", 2.0), (5, "a", 2.1), (6, "b", 0.5), (7, None, 1.0), (8, "a", None), (9, "a", -0.9), (10, "a", 1e9)]
    df = spark.createDataFrame(rows, "id int, k string, v double")
    want = {i: sum(k == m and w is not None and j != i and abs(v - w) <= 1.0 for j, m, w in rows) for i, k, v in rows if k and v is not None}
    assert {r.id: r.near for r in relational.band_counts(df, "k", "v", "id", 1.0).collect()} == want
    assert relational.band_counts(df.limit(0), "k", "v", "id", 1.0).count() == 0


def test_patient_records_and_members(spark):
    from strandline.operators import clinical

    rows = spark.createDataFrame([("P", 7, 1, "70", None, "a"), ("P", 7, 2, None, "28", "b"), (" ", 8, 1, "60", None, None), (None, None, 1, "1", "1", "1")], "PTID string, RID int, n int, AGE string, MMSE string, other string")
    got = {r.patient: (r.demographic, r.family_history, r.clinical, r.assessment) for r in clinical.patient_records(rows, ["n"]).collect()}
    assert got == {"P": ({"AGE": "70"}, {}, {"n": "2", "other": "b"}, {"MMSE": "28"}), "8": ({"AGE": "60"}, {}, {"n": "1"}, {})}
    family = spark.createDataFrame([("P", "yes", "70.0", None), ("P", "yes", "70.0", None), ("Q", "?", "x", "F"), (None, "no", None, None)], "PTID string, DEMENTIA string, ONSET_AGE string, SEX string")
    found = sorted(((r.patient, r.relation, r.has_dementia, r.onset, r.gender) for r in clinical.members_of_rows({"SIB_FAMILY": family, "other": family}).collect()), key=str)
    assert found == [("P", "sibling", True, 70, None), ("Q", "sibling", None, None, "F")]


def test_canonical_snapshot(spark):
    from strandline.operators import clinical

    nodes = spark.createDataFrame([("A", "u"), ("A", None), (None, "u")], "label string, uri string")
    edges = spark.createDataFrame([("T", None)], "type string, uri string")
    row = clinical.canonical_snapshot(nodes, edges, {"a": ("nodes", "label = 'A'"), "none": ("edges", "uri = 'x'")}).first()
    assert (row.node_total, row.labels, row.nodes_with_uri, row.a, row.none, row.node_coverage, row.edge_coverage, row.by_label, row.by_type) == (3, 1, 2, 2, 0, 0.6667, 0.0, {"A": 2}, {"T": 1})
    empty = clinical.canonical_snapshot(nodes.limit(0), edges.limit(0), {}).first()
    assert (empty.node_total, empty.edge_coverage, empty.by_label) == (0, 0.0, {})


def test_stages_and_atrophy(spark):
    dx = spark.createDataFrame([(1, "mild_impairment"), (1, "severe_impairment"), (2, "x"), (3, None), (4, "moderate_impairment")], "ptid int, severity string")
    findings = spark.createDataFrame([(2, "abnormal"), (3, "normal"), (4, "abnormal"), (5, "abnormal")], "ptid int, significance string")
    assert sorted(tuple(r) for r in profiles.current_stages(dx, findings).collect()) == [(1, "severe_ad"), (2, "preclinical"), (4, "moderate_ad"), (5, "preclinical")]
    assert profiles.stage_progressions()[0] == ("preclinical", "mci") and len(profiles.stage_progressions()) == 4
    images = spark.createDataFrame([(1, "r", "MRI"), (1, "r", "PET"), (1, None, "MRI"), (2, "r", None), (3, "r", "MRI")], "ptid int, region string, modality string")
    found = spark.createDataFrame([(1, "psychometric", 6), (1, "psychometric", -6), (1, "psychometric", 7), (2, "psychometric", 0), (3, "other", 0)], "ptid int, kind string, months int")
    assert sorted(tuple(r) for r in profiles.atrophy_links(images, found).collect()) == [(1, "r", ["MRI", "PET"], 2), (2, "r", [], 1)]
    genes = spark.createDataFrame([("P", "4/4", None), ("P", "E3/E4", "m06"), ("Q", None, "bl"), (None, "3/3", "bl")], "PTID string, GENOTYPE string, VISCODE string")
    assert sorted((r.biomarker_id, r.value, r.abnormal) for r in measures.genotype_rows(genes, "G").collect()) == [("bio_P_APOE_bl", 12.0, True), ("bio_P_APOE_m06", 3.0, True)]
