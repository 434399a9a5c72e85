"""Queries over sources, upserts and multi-source extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.operators.components import shared_folder
from strandline.plans.cohort import query
from strandline.sources import tables as s


def _folder(t, name: str) -> str:
    """A folder of this run in the shared folder, for data that Spark writes from the tables."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_read_table_folder", "SELECT pid, CASE WHEN genotype = 'E4/E4' THEN NULL ELSE genotype END AS genotype FROM patients")
def s01(t):
    folder = _folder(t, "csv")
    rows = t.patients.select("pid", F.expr("CASE WHEN genotype = 'E4/E4' THEN 'N/A' ELSE genotype END").alias(" genotype "))
    rows.repartition(1).write.csv(folder, header=True)
    return next(iter(s.read_csv_folder(t.spark, folder).values())).select(F.col("pid").cast("long"), "genotype")


@query("s02_resolve_table", "SELECT pid, dx FROM visits WHERE dx = 'AD'")
def s02(t):
    tables = {f"STUDY_{dx}_20240101": t.visits.where(f"dx = '{dx}'") for dx in ("AD", "MCI", "CN")}
    return tables[s.resolve_table(list(tables), "AD")].select("pid", "dx")


@query("s03_categorize_tables", "SELECT DISTINCT p_name AS name, CASE WHEN contains(p_name, 'red') THEN 'imaging' WHEN contains(p_name, 'gear') THEN 'clinical' ELSE 'other' END AS category FROM part")
def s03(t):
    rules = t.spark.createDataFrame([("RED", "imaging", 1), ("GEAR", "clinical", 2)], "word string, category string, priority int")
    return s.categorize(t.part.select(F.col("p_name").alias("name")).distinct(), rules)


@query("s04_standardize", """SELECT concat('S', pid) AS "PTID", 'm06' AS "VISCODE" FROM patients""")
def s04(t):
    return s.standardize(t.patients.select(F.concat(F.lit(" S"), "pid").alias("SUBJID"), F.lit(" M06 ").alias("VISCODE2"))).select("PTID", "VISCODE")


@query("s05_profile", "SELECT 'visits' AS name, count(*) AS n_rows, 9::int AS n_columns, count(DISTINCT pid) AS n_keys FROM visits UNION ALL SELECT 'patients', count(*), 9::int, count(DISTINCT pid) FROM patients")
def s05(t):
    return s.profile({"visits": t.visits, "patients": t.patients}, "pid")


@query("s05_top_values", "SELECT 'dx' AS \"column\", dx AS value, count(*) AS n FROM visits GROUP BY dx UNION ALL SELECT 'status', status, count(*) FROM visits GROUP BY status")
def s05b(t):
    return s.top_values(t.visits, ["dx", "status"])


@query("s06_wide_longitudinal", "SELECT 'Diagnosis' AS entity, vid AS key, dx AS value FROM visits UNION ALL SELECT 'Score', vid, mmse::varchar FROM visits WHERE mmse > 3")
def s06(t):
    return s.wide_to_entities(t.visits.withColumn("score", F.expr("CASE WHEN mmse > 3 THEN mmse END")), "vid", {"dx": "Diagnosis", "score": "Score"})


@query("s07_rule_catalog", "SELECT concat('part:', p_partkey) AS target_uri, p_name AS target_label FROM part")
def s07(t):
    folder = _folder(t, "rules")
    cols = [F.lit("DXSUM"), F.lit("DX"), F.col("p_partkey").cast("string"), F.lit("PART"), F.concat(F.lit("part:"), "p_partkey"), F.col("p_name"), F.lit("r"), F.lit("f"), F.lit("2024-01-31")]
    names = [c.split()[0] for c in s.RULE_SCHEMA.split(", ")]
    t.part.select(*[c.alias(n) for c, n in zip(cols, names)]).write.csv(folder, header=True)
    return s.read_rules(t.spark, folder).where("file <> '' and last_verified_date = date'2024-01-31'").select("target_uri", "target_label")


@query("m04_rule_inventory", "SELECT p_brand AS target_ontology, count(*) AS rules, DATE '2024-01-01' + min(p_size) AS first_date, DATE '2024-01-01' + max(p_size) AS last_date FROM part GROUP BY 1")
def m04(t):
    rows = t.part.select(F.col("p_brand").alias("target_ontology"), F.expr("date_add(date'2024-01-01', p_size)").alias("d"))
    return rows.groupBy("target_ontology").agg(F.count("*").alias("rules"), F.min("d").alias("first_date"), F.max("d").alias("last_date"))


@query("s08_json_dictionary", "SELECT concat('N', n_nationkey) AS code, n_name AS label, concat('R', n_regionkey) AS parent, 'dictionary' AS resolved_via FROM nation")
def s08(t):
    folder = _folder(t, "dict")
    entry = F.struct(F.concat(F.lit("N"), "n_nationkey").alias("k"), F.struct(F.col("n_name").alias("label"), F.concat(F.lit("R"), "n_regionkey").alias("parent")).alias("v"))
    t.nation.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(folder)
    return s.read_json_dictionary(t.spark, folder)


@query("s09_parse_node_dump", "SELECT DISTINCT 'Gene' AS kind, p_name AS label, concat('kb:Gene_', substring(p_name, 1, 40)) AS id FROM part WHERE contains(lower(p_name), 'gear') ORDER BY id LIMIT 200")
def s09(t):
    lines = t.part.select(F.concat(F.lit("CREATE (n:Gene {label: '"), "p_name", F.lit("', x: 1})")).alias("value"))
    return s.parse_node_lines(lines, ["Gene", "Drug", "Disease"], "gear")


@query("s10_image_inventory", "SELECT 'dicom' AS kind, count(*) AS n FROM (SELECT DISTINCT n_regionkey FROM nation)")
def s10(t):
    folder = _folder(t, "images")
    t.nation.select("n_regionkey", F.lit("x").alias("value")).repartition("n_regionkey").write.partitionBy("n_regionkey").option("compression", "none").text(folder)
    files = s.list_files(t.spark, folder).withColumn("path", F.regexp_replace("path", r"\.txt$", ".dcm"))
    found = s.image_inventory(files).select("kind", F.regexp_extract("path", r"n_regionkey=(\d+)", 1).alias("r"))
    return found.groupBy("kind").agg(F.count_distinct("r").alias("n"))


@query("s11_write_entities", "SELECT label, count(*) AS n FROM nodes GROUP BY 1")
def s11(t):
    folder = _folder(t, "entities")
    s.write_entities(t.nodes, folder)
    return t.spark.read.parquet(folder).groupBy("label").agg(F.count("*").alias("n"))


@query("s12_export", "SELECT pid, gender FROM patients ORDER BY pid LIMIT 100")
def s12(t):
    folder = _folder(t, "json")
    t.patients.orderBy("pid").limit(100).select("pid", "gender").write.json(folder)
    return t.spark.read.json(folder).select("pid", "gender")


@query("s13_search_documents", "SELECT count(*) AS n, count(*) FILTER (WHERE d) AS dated FROM (SELECT hash, bool_or(true) AS d FROM (SELECT md5(text) AS hash FROM documents) WHERE hash NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY 1)")
def s13(t):
    rows = t.documents.select("doc_id", F.md5("text").alias("hash"), F.lit("2024-02-30").alias("d"))
    rows = rows.withColumn("d", F.lit("2024-02-03"))
    return s.new_documents(rows, rows.where("doc_id % 10 = 0"), "hash", "d").agg(F.count("*").alias("n"), F.count("d").alias("dated"))


@query("u01_merge_upsert", "SELECT pid, CASE WHEN pid % 3 = 0 THEN segment ELSE 'NEW' END AS segment, CASE WHEN pid % 3 = 0 AND pid % 2 = 0 THEN 'a,b' WHEN pid % 3 = 0 THEN 'a' ELSE 'b' END AS sources FROM patients WHERE pid % 3 = 0 OR pid % 2 = 0")
def u01(t):
    old = t.patients.where("pid % 3 = 0").select("pid", "segment", F.array(F.lit("a")).alias("sources"))
    new = t.patients.where("pid % 2 = 0").select("pid", F.lit("NEW").alias("segment"), F.array(F.lit("b")).alias("sources"))
    return s.merge_upsert(old, new, "pid", ("sources",)).withColumn("sources", F.array_join("sources", ","))


@query("u02_merge_if_changed", "SELECT pid, CASE WHEN pid % 4 = 0 THEN age + 1 ELSE age END::int AS age, CASE WHEN pid % 5 = 0 THEN 'new' ELSE 'old' END AS created_at FROM patients")
def u02(t):
    old = t.patients.where("pid % 5 <> 0").select("pid", "age", F.lit("old").alias("created_at"))
    new = t.patients.select("pid", F.expr("CASE WHEN pid % 4 = 0 THEN age + 1 ELSE age END").cast("int").alias("age"), F.lit("new").alias("created_at"))
    digest = F.sha2(F.col("age").cast("string"), 256)
    return s.merge_if_changed(old.withColumn("_hash", digest), new.withColumn("_hash", digest), "pid").select("pid", "age", "created_at")


@query("u03_row_hash", """SELECT pid, sha256(concat('{"age":', age, ',"gender":"', gender, '"', CASE WHEN genotype IS NULL THEN '' ELSE concat(',"genotype":"', genotype, '"') END, ',"pid":', pid, '}')) AS hash FROM patients""")
def u03(t):
    rows = t.patients.select("pid", "gender", "age", "genotype", F.lit("x").alias("_batch_id"))
    return rows.select("pid", s.row_hash(rows).alias("hash"))


@query("u04_batch_ledger", "SELECT concat('b', pid % 3) AS _batch_id, 'visits' AS _source_table, count(*) AS total_rows, count(*) FILTER (WHERE dx <> 'CN') AS written_rows FROM visits GROUP BY 1")
def u04(t):
    return s.ledger(t.visits.select(F.expr("concat('b', pid % 3)").alias("_batch_id"), F.lit("visits").alias("_source_table"), F.expr("dx <> 'CN'").alias("_written")))


@query("u05_skip_processed", "WITH files AS (SELECT page_id, substring(md5(concat_ws('_', url, length(html), 0)), 1, 16) AS id FROM pages) SELECT id FROM files WHERE id NOT IN (SELECT id FROM files WHERE page_id % 2 = 0)")
def u05(t):
    rows = t.pages.select("page_id", s.file_identity(F.col("url"), F.char_length("html"), F.lit(0)).alias("id"))
    return rows.join(rows.where("page_id % 2 = 0").select("id"), "id", "left_anti").select("id")


@query("u06_member_id", "SELECT pid, concat('fm_', substring(md5(concat(pid, '_mother_MOTHDEM')), 1, 12)) AS member FROM patients")
def u06(t):
    return t.patients.select("pid", s.member_id(F.col("pid").cast("string"), F.lit("mother"), F.lit("MOTHDEM")).alias("member"))


@query("u07_referenced_missing", "SELECT k, substring(k, 1, 10) AS subject FROM (SELECT DISTINCT concat(lpad((pid % 1000)::varchar, 3, '0'), '_S_', lpad((pid % 10000)::varchar, 4, '0'), '_', dx) AS k, dx FROM visits) WHERE dx <> 'CN'")
def u07(t):
    keys = t.visits.select(F.expr("concat(lpad(string(pid % 1000), 3, '0'), '_S_', lpad(string(pid % 10000), 4, '0'), '_', dx)").alias("k"), "dx")
    return s.referenced_missing(keys, keys.where("dx = 'CN'"), "k")


@query("u08_required_split", "SELECT genotype IS NOT NULL AS valid, count(*) AS n FROM patients GROUP BY 1")
def u08(t):
    good, bad = s.required_split(t.patients, ["pid", "genotype"])
    return good.agg(F.lit(True).alias("valid"), F.count("*").alias("n")).unionByName(bad.agg(F.lit(False).alias("valid"), F.count("*").alias("n")))


@query("e01_crosswalk", "SELECT vid AS \"RID\", CASE WHEN dx = 'AD' THEN concat('B', pid) ELSE concat('A', pid) END AS \"PTID\" FROM visits")
def e01(t):
    a = t.visits.select(F.col("vid").alias("RID"), F.concat(F.lit("A"), "pid").alias("PTID"))
    b = t.visits.where("dx = 'AD'").select(F.col("vid").alias("RID"), F.concat(F.lit("B"), "pid").alias("PTID"))
    return s.crosswalk([a, t.patients, b], "RID", "PTID")


@query("e02_attributes", "SELECT pid, gender, CASE WHEN pid % 2 = 0 THEN age + 100 ELSE age END::int AS age, CASE WHEN pid % 2 = 0 THEN '0,1' ELSE '0' END AS tables FROM patients")
def e02(t):
    late = t.patients.where("pid % 2 = 0").select("pid", F.expr("age + 100").alias("age"))
    return s.attributes([t.patients.select("pid", "gender", "age"), late], "pid", ["gender", "age"]).withColumn("tables", F.array_join(F.transform("tables", lambda x: x.cast("string")), ","))


@query("e03_universe", "SELECT DISTINCT x::varchar AS id FROM (SELECT pid AS x FROM visits UNION SELECT pid FROM patients UNION SELECT s_suppkey FROM supplier)")
def e03(t):
    return s.universe([t.visits.select(F.col("pid").alias("PTID")), t.patients.select(F.col("pid").alias("RID")), t.supplier.select(F.col("s_suppkey").alias("SUBJID"))], ("PTID", "RID", "SUBJID"))


@query("e04_visit_extraction", "SELECT pid, months, min(vdate) AS vdate, CASE WHEN months = 0 THEN 'baseline' ELSE 'followup' END AS type, count(*) AS sources FROM visits GROUP BY pid, months")
def e04(t):
    rows = t.visits.groupBy("pid", "months").agg(F.min("vdate").alias("vdate"), F.size(F.collect_list("vid")).cast("long").alias("sources"))
    return rows.withColumn("type", F.when(F.col("months") == 0, "baseline").otherwise("followup"))


@query("e05_diagnosis_extraction", "SELECT dx, source, confidence, count(*) AS n FROM (SELECT dx, 'DXSUM' AS source, CASE WHEN mmse > 20 THEN 0.95 WHEN mmse > 10 THEN 0.75 ELSE 0.5 END::double AS confidence FROM visits UNION ALL SELECT CASE WHEN mmse >= 27 THEN 'CN' WHEN mmse >= 21 THEN 'MCI' ELSE 'AD' END, 'MMSE', 0.75::double FROM visits) GROUP BY ALL")
def e05(t):
    from strandline.functions.clean import score_to_diagnosis

    one = t.visits.select("dx", F.lit("DXSUM").alias("source"), F.expr("CASE WHEN mmse > 20 THEN 0.95D WHEN mmse > 10 THEN 0.75D ELSE 0.5D END").alias("confidence"))
    two = t.visits.select(score_to_diagnosis(F.col("mmse")).alias("dx"), F.lit("MMSE").alias("source"), F.lit(0.75).alias("confidence"))
    return one.unionByName(two).groupBy("dx", "source", "confidence").agg(F.count("*").alias("n"))


_PTID = "concat(lpad((pid % 1000)::varchar, 3, '0'), '_S_', lpad((pid % 10000)::varchar, 4, '0'))"


def _ptid():
    return F.expr("concat(lpad(string(pid % 1000), 3, '0'), '_S_', lpad(string(pid % 10000), 4, '0'))")


@query("e04_all_tables", f"""SELECT concat_ws('_', ptid, viscode) AS visit_id, viscode, cast(CASE WHEN viscode IN ('bl', 'sc') THEN 0 ELSE substring(viscode, 2)::int END AS int) AS months,
    CASE WHEN count(*) FILTER (WHERE k = 0 AND d IS NOT NULL) > 0 THEN min(d) FILTER (WHERE k = 0) ELSE min(d) END AS visit_date, CASE WHEN viscode IN ('bl', 'sc') THEN 'baseline' ELSE 'follow-up' END AS visit_type, string_agg(DISTINCT s, ',' ORDER BY s) AS sources
    FROM (SELECT {_PTID} AS ptid, CASE WHEN months = 0 THEN 'bl' ELSE concat('m', CASE WHEN months < 10 THEN '0' ELSE '' END, months) END AS viscode, CASE WHEN dx <> 'CN' THEN vdate::varchar END AS d, 0 AS k, 'A' AS s FROM visits
    UNION ALL SELECT {_PTID}, concat('m', CASE WHEN months < 10 THEN '0' ELSE '' END, months), fdate::varchar, 1, 'B' FROM facts) WHERE NOT starts_with(ptid, '381_S_') GROUP BY ptid, viscode""")  # fmt: skip
def e04_all(t):
    """Two tables with other columns and spellings: VISCODE2 before VISCODE and PTID; VISIT as month N and RID with a crosswalk."""
    code = F.expr("CASE WHEN months = 0 THEN 'baseline' ELSE concat('M', lpad(string(months), greatest(2, length(string(months))), '0')) END")
    one = t.visits.select(_ptid().alias("PTID"), F.lit("v01").alias("VISCODE"), code.alias("VISCODE2"), F.expr("CASE WHEN dx <> 'CN' THEN vdate END").alias("EXAMDATE"))
    two = t.facts.select(F.concat(F.lit(" "), "pid").alias("RID"), F.expr("concat('Month ', months)").alias("VISIT"), F.col("fdate").alias("VISDATE"))
    known = t.patients.select(F.col("pid").alias("RID"), _ptid().alias("PTID"))
    return s.visits_of({"A": one, "none": t.nation, "B": two}, known).select("visit_id", "viscode", "months", "visit_date", "visit_type", F.array_join("sources", ",").alias("sources"))


@query("e05_five_sources", f"""SELECT concat('dx_', ptid, '_', viscode, '_', code, mark) AS diagnosis_id, code, confidence, source FROM (
    SELECT {_PTID} AS ptid, concat('v', vid) AS viscode, CASE WHEN vid % 3 = 0 THEN CASE dx WHEN 'AD' THEN 'AD' WHEN 'MCI' THEN 'MCI' ELSE 'CN' END WHEN dx = 'AD' THEN 'AD' WHEN dx = 'MCI' THEN CASE WHEN mmse % 3 = 1 THEN 'EMCI' WHEN mmse % 3 = 2 THEN 'LMCI' ELSE 'MCI' END WHEN dx = 'CN' THEN 'CN' END AS code,
        CASE mmse % 4 WHEN 2 THEN 0.75 WHEN 3 THEN 0.5 ELSE 0.95 END::double AS confidence, 'DXSUM' AS source, '' AS mark FROM visits
    UNION ALL SELECT {_PTID}, 'screening', CASE WHEN pid % 2 = 0 THEN 'EMCI' ELSE 'SMC' END, 1.0, 'ARM', '' FROM patients
    UNION ALL SELECT {_PTID}, 'bl', 'AD', 0.85, 'BLCHANGE', '_predicted' FROM patients WHERE age > 70
    UNION ALL SELECT {_PTID}, concat('v', vid), CASE WHEN mmse % 4 = 0 THEN 'CN' WHEN mmse % 4 = 1 THEN 'MCI' WHEN mmse % 4 = 3 THEN 'AD' END, 0.8, 'CDR', '_CDR' FROM visits
    UNION ALL SELECT {_PTID}, concat('v', vid), CASE WHEN mmse >= 27 THEN 'CN' WHEN mmse >= 21 THEN 'MCI' ELSE 'AD' END, 0.75, 'MMSE', '_MMSE' FROM visits) WHERE code IS NOT NULL""")  # fmt: skip
def e05_all(t):
    v = t.visits.withColumn("PTID", _ptid()).withColumn("VISCODE2", F.expr("concat('v', vid)"))
    return s.diagnoses_of({
        "DXSUM": v.select("PTID", "VISCODE2", F.expr("CASE WHEN vid % 3 = 0 THEN CASE dx WHEN 'AD' THEN '3' WHEN 'MCI' THEN '2' ELSE '1' END END").alias("DIAGNOSIS"), F.expr("int(dx = 'AD')").alias("DXAD"), F.expr("int(dx = 'MCI')").alias("DXMCI"), F.expr("mmse % 3").alias("DXMDES"), F.expr("int(dx = 'CN')").alias("DXNORM"), F.expr("mmse % 4").alias("DXCONFID")),
        "ARM": t.patients.select(_ptid().alias("PTID"), F.expr("CASE WHEN pid % 2 = 0 THEN 'EMCI' ELSE 'SMC' END").alias("ARM")),
        "BLCHANGE": t.patients.select(_ptid().alias("PTID"), F.expr("CASE WHEN age > 70 THEN 3 END").alias("BCPREDX")),
        "CDR": v.select("PTID", "VISCODE2", F.expr("CASE mmse % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 1 END").alias("CDGLOBAL")),
        "MMSE": v.select("PTID", "VISCODE2", F.col("mmse").alias("MMSCORE")),
    }).select("diagnosis_id", "code", "confidence", "source")


@query("e06_e09_unpivot", "SELECT vid, 'mmse' AS test, mmse::double AS score FROM visits UNION ALL SELECT vid, 'price', price FROM visits")
def e06(t):
    return s.unpivot(t.visits.select("vid", F.col("mmse").cast("double").alias("mmse"), "price"), ["vid"], ["mmse", "price"], "test", "score")


@query("e07_biomarker_rules", "SELECT analyte, unit, count(*) AS n, sum((value > threshold)::int)::bigint AS flagged FROM facts JOIN (VALUES ('TAU', 'pg/mL', 30.0), ('PTAU', 'pg/mL', 20.0)) r(a, unit, threshold) ON analyte = a GROUP BY ALL")
def e07(t):
    rules = t.spark.createDataFrame([("TAU", "pg/mL", 30.0), ("PTAU", "pg/mL", 20.0)], "analyte string, unit string, threshold double")
    return t.facts.join(F.broadcast(rules), "analyte").groupBy("analyte", "unit").agg(F.count("*").alias("n"), F.count_if(F.col("value") > F.col("threshold")).alias("flagged"))


@query("e10_family_members", "SELECT pid, relation, concat('fm_', substring(md5(concat(pid, '_', relation, '_', col)), 1, 12)) AS member FROM (SELECT pid, 'mother' AS relation, 'MOTHALZ' AS col FROM patients WHERE pid % 2 = 0 UNION ALL SELECT pid, 'father', 'FATHDEM' FROM patients WHERE pid % 3 = 0)")
def e10(t):
    wide = t.patients.select("pid", F.expr("CASE WHEN pid % 2 = 0 THEN 'yes' ELSE 'no' END").alias("MOTHALZ"), F.expr("CASE WHEN pid % 2 = 0 THEN '1' END").alias("MOTHDEM"), F.expr("CASE WHEN pid % 3 = 0 THEN 'Dementia' END").alias("FATHDEM"), F.lit("1").alias("RIDX"))
    return s.family_members(wide, "pid")


@query("e11_vitals", "SELECT vid, 'pulse' AS vital, (40 + mmse * 4)::double AS value FROM visits WHERE 40 + mmse * 4 BETWEEN 50 AND 120")
def e11(t):
    from strandline.functions.clean import in_range

    wide = t.visits.select("vid", in_range(F.expr("double(40 + mmse * 4)"), 50, 120).alias("pulse"))
    return s.unpivot(wide, ["vid"], ["pulse"], "vital", "value")


@query("e12_e13_flags", "SELECT DISTINCT pid, category FROM (SELECT pid, 'cardio' AS category FROM visits WHERE mmse > 25 UNION ALL SELECT pid, 'renal' FROM visits WHERE mmse < 3)")
def e12(t):
    wide = t.visits.select("pid", F.expr("int(mmse > 25)").alias("cardio"), F.expr("int(mmse < 3)").alias("renal"))
    return s.unpivot(wide, ["pid"], ["cardio", "renal"], "category", "flag").where("flag = 1").select("pid", "category").distinct()


@query("e14_generic_findings", "SELECT vid AS key, round(mmse::double, 6) AS mmse, dx AS note, 0.4::double AS confidence FROM visits")
def e14(t):
    rows = s.generic_findings(t.visits.select("vid", "mmse", "dx", "status", "months"), "vid", "visits")
    return rows.select("key", F.element_at("scores", "mmse").alias("mmse"), F.element_at("notes", "dx").alias("note"), "confidence")
