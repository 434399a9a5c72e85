"""Second cohort, files, provenance, ontology edges: odd rows and whole small cases."""

import json

from pyspark.sql import functions as F

from strandline.operators import ontology
from strandline.sources import entities, files


def test_image_files(spark, tmp_path):
    marked = bytes(128) + b"DICM" + bytes(100_100)
    layout = {
        "a.dcm": b"x", "b.IMA": b"", "c.nii": b"", "sub/d.NII.gz": b"", "sub/deep/e": marked, "sub/deep/er/f": bytes(100_300), "g": marked[:50_000], "h.tar.gz": marked, ".i.dcm": b"", "sub/thumbnails/j.dcm": b"", "metadata/k.dcm": b"", "sub/.hidden/l.dcm": b"", "m.x": marked,
    }
    for name, data in layout.items():
        place = tmp_path / "in" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(data)
    (tmp_path / "none").mkdir()
    for tasks in (1, 2, 100):
        found = files.image_files(spark, str(tmp_path / "in"), tasks).collect()
        got = sorted((r.path.split("/in/")[1], r.length, r.kind) for r in found)
        assert got == [("a.dcm", 1, "dicom"), ("b.IMA", 0, "dicom"), ("c.nii", 0, "nifti"), ("sub/.hidden/l.dcm", 0, "dicom"), ("sub/d.NII.gz", 0, "nifti"), ("sub/deep/e", len(marked), "dicom")]
    assert files.image_files(spark, f"file://{tmp_path}/none").count() == 0


def test_session_entities(spark):
    rows = [
        ("S1", "M1", "1", "Nondemented", "M", "R", "70", "12", "2", "0", "29", "0", "0.7", "1500", "1.1"), ("S1", "M2", "2", "Converted", "M", "R", "72", "12", None, "700", None, "0.5", None, None, None),
        ("S2", None, "1", "x", "F", "R", "60", "9", "1", "0", "30", "0", "0.8", "1", "1"), (None, "M3", "1", "g", None, None, None, None, None, None, " ", "bad", " ", None, None), ("S1", "M1", "1", "Nondemented", "M", "R", "70", "12", "2", "0", "29", "0", "0.7", "1500", "1.1"),
    ]
    names = ["Subject ID", "MRI ID", "Visit", "Group", "M/F", "Hand", "Age", "EDUC", "SES", "MR Delay", "MMSE", "CDR", "nWBV", "eTIV", "ASF"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    found, edges = entities.session_entities(df, "two")
    got = {(r.kind, r.key): r.properties for r in found.collect()}
    assert set(got) == {("Patient", "S1"), *((("Visit", m)) for m in ("M1", "M2", "M3")), ("Diagnosis", "dx_M1"), ("Diagnosis", "dx_M2"), ("CognitiveAssessment", "M1_MMSE"), ("CognitiveAssessment", "M1_CDR"), ("CognitiveAssessment", "M2_CDR"), ("BrainRegion", "M1_Whole Brain")}
    assert got["Patient", "S1"] == {"sex": "M", "hand": "R", "educ": "12", "ses": "2"} and got["Diagnosis", "dx_M2"] == {"diagnosis_code": "AD", "cdr": "0.5", "group": "Converted"} and got["Visit", "M3"] == {"viscode": "1", "group": "g"}
    assert got["BrainRegion", "M1_Whole Brain"] == {"name": "Whole Brain", "nwbv": "0.7", "etiv": "1500", "asf": "1.1"}
    links = sorted(tuple(r) for r in edges.collect())
    assert ("S1", "HAS_VISIT", "M1") in links and len(links) == 8 and not any(x[2] == "M3" for x in links)
    none, no_edges = entities.session_entities(df.limit(0), "two")
    assert none.count() == 0 and no_edges.count() == 0
    only, _ = entities.session_entities(df.select("Subject ID", "MRI ID", "CDR"), "two")
    assert {r.kind for r in only.collect()} == {"Patient", "Visit", "Diagnosis", "CognitiveAssessment"}


def test_session_entities_of_repeated_keys(spark):
    """Each property's greatest text among the rows that have the entity, however many; a session's rows are not multiplied by its properties before they meet."""
    names = ["Subject ID", "MRI ID", "Group", "CDR", "MMSE", "nWBV", "eTIV", "EDUC"]
    rows = [("S1", "M1", "b", "0", "9", "0.7", "1", None), ("S1", "M1", "z", None, "10", None, "9", "8"), ("S2", "M1", "a", "0.5", None, "0.6", "2", None), (" S2 ", "M2", None, "x", None, None, "3", None)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    found, _ = entities.session_entities(df, "two")
    got = {(r.kind, r.key): r.properties for r in found.collect()}
    assert got == {
        ("Patient", "S1"): {"educ": "8"}, ("Patient", "S2"): {}, ("Visit", "M1"): {"group": "z"}, ("Visit", "M2"): {}, ("Diagnosis", "dx_M1"): {"diagnosis_code": "CN", "cdr": "0.5", "group": "b"},
        ("CognitiveAssessment", "M1_MMSE"): {"test_name": "MMSE", "value": "9"}, ("CognitiveAssessment", "M1_CDR"): {"test_name": "CDR", "value": "0.5"}, ("BrainRegion", "M1_Whole Brain"): {"name": "Whole Brain", "nwbv": "0.7", "etiv": "2"},
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "collect_list" not in plan


def test_entity_tables_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "c")], "id int, v string")
    again = [entities.write_entity_tables({"k": (rows, "t")}, str(tmp_path), "b", {"k": ["id"]}).first().asDict() for _ in range(2)]
    assert again == [{"kind": "k", "source_table": "t", "total_rows": 4, "written_rows": 2, "batch_id": "b"}] * 2
    entities.write_entity_tables({"k": (rows, "t")}, str(tmp_path), "c")
    stored = spark.read.parquet(str(tmp_path / "k"))
    assert stored.count() == 5 and stored.select("_hash").distinct().count() == 3 and {r._batch_id for r in stored.collect()} == {"b", "c"}
    # the hash doesn't know the batch
    assert entities.with_provenance(entities.with_provenance(rows, "x", "y"), "z", "w").select("_hash").distinct().count() == 3


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 2 else f"v,{i}\"q") for i in range(150)], "i int, v string")
    entities.export_json(rows, str(tmp_path / "j"), ["i"])
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 100 and lines[1] == {"i": 1, "v": None}
    entities.export_audit(rows.withColumn("l", F.array(F.lit(1), F.lit(2))), str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.count() == 150 and back.where("i = 2").first().asDict() == {"i": "2", "v": 'v,2"q', "l": "1|2"}
    report = json.loads(entities.metric_report({"a": rows.limit(2), "b": rows.limit(0)}).first().report)
    assert report == {"a": [{"i": 0, "v": 'v,0"q'}, {"i": 1}], "b": []}


def test_ontology_edges(spark):
    known = spark.createDataFrame([("u1", "c", None, "O", None)], "uri string, code string, label string, source_ontology string, purl string")
    new = spark.createDataFrame([("u1", "other", "L", "N", "p"), ("u2", "b", None, "N", None), ("u2", "a", None, "N", None), (None, "x", "x", "x", "x")], known.schema)
    got = {r.uri: tuple(r)[1:] for r in ontology.merge_concepts(known, new).collect()}
    assert got == {"u1": ("c", "L", "O", "p", False), "u2": ("a", None, "N", None, True)}
    assert ontology.merge_concepts(known, known).where("created").count() == 0
    found = spark.createDataFrame([("A", "B", ["x", "x", "y"], 0.5), ("B", "C", ["x"], 1.0)], "source string, target string, algorithms array<string>, confidence double")
    edges = ontology.embed_causes(found, {"A": ("u1", "a", "O"), "C": ("gone", "c", "O")}, known)
    assert sorted((r.src, r.type, r.dst) for r in edges.collect()) == [("cohort:B", "CAUSES", "gone"), ("u1", "CAUSES", "cohort:B"), ("variable:A", "MAPS_TO", "u1")]
    assert ontology.embed_causes(found, {}, known).where("type = 'MAPS_TO'").count() == 0
    assert {r.algorithm: r.n for r in ontology.edges_by_algorithm(found).collect()} == {"x": 2, "y": 1}
    assert tuple(ontology.causal_totals(found.withColumn("validated", F.lit(None).cast("boolean")).limit(0)).first()) == (0, 0, 0.0)


def test_keys_and_codes(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "c"), (2, None)], "i int, s string")
    got = {r.key: (r.n, r.nulls, r.repeated, r.holds) for r in ontology.keys_hold({"one": (rows, ["i"]), "both": (rows, ["i", "s"]), "fine": (rows.limit(1), ["i"]), "none": (rows.limit(0), ["i"])}).collect()}
    assert got == {"one": (5, 1, 2, False), "both": (5, 2, 1, False), "fine": (1, 0, 0, True), "none": (0, 0, 0, True)}
    nodes = spark.createDataFrame([("A", "x", 1), ("A", None, 2), ("B", None, 1)], "label string, code string, k int")
    found = {(r.label, r.total): (r.with_code, r.coverage, r.passed, r.hard_fail) for r in ontology.codes_by_label(nodes, [("A", "code", 0.5, None), ("A", "code", 0.9, "k = 1"), ("B", "code", 0.1, None), ("C", "code", 0.0, None)]).collect()}
    assert found == {("A", 2): (1, 0.5, True, False), ("A", 1): (1, 1.0, True, False), ("B", 1): (0, 0.0, False, False), ("C", 0): (0, 0.0, False, True)}
    assert tuple(ontology.forbidden_prefix(rows.limit(0), "s", "a").first()) == (0, [])
    assert tuple(ontology.forbidden_prefix(rows, "s", "b").first()) == (2, ["b"])


def test_entity_tables_read_their_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    kept = F.udf(lambda _: seen.add(1) or True, "boolean").asNondeterministic()
    rows = spark.createDataFrame([(1, 0.0), (1, -0.0), (1, 0.0), (2, None)], "id int, v double").coalesce(1).where(kept("id"))
    got = entities.write_entity_tables({"k": (rows, "t")}, str(tmp_path), "b", {"k": ["v"]}).first()
    assert (got.total_rows, got.written_rows, seen.value) == (4, 2, 4)
