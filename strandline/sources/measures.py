"""Vitals, comorbidities and laboratory values of wide tables as rows with codes, by rule tables."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.clean import abnormal_flag, clean_numeric, flag_truthy, genotype_risk


class Vital(NamedTuple):
    name: str
    code: str
    column: str
    unit: str
    low: float
    high: float


class Analyte(NamedTuple):
    column: str
    name: str
    unit: str
    specimen: str
    threshold: float | None
    direction: str


# Vital signs with code, column, unit and plausible range; the last is derived.
VITALS = (
    Vital("SystolicBP", "8480-6", "VSBPSYS", "mmHg", 60.0, 260.0),
    Vital("DiastolicBP", "8462-4", "VSBPDIA", "mmHg", 30.0, 180.0),
    Vital("BodyWeight", "29463-7", "VSWEIGHT", "kg", 25.0, 250.0),
    Vital("BodyHeight", "8302-2", "VSHEIGHT", "cm", 100.0, 230.0),
    Vital("HeartRate", "8867-4", "VSPULSE", "bpm", 30.0, 220.0),
    Vital("BodyMassIndex", "39156-5", "derived(VSWEIGHT,VSHEIGHT)", "kg/m^2", 10.0, 80.0),
)
CODE_PREFIX = "http://purl.bioontology.org/ontology/LNC/"
# Comorbidity, code and flag column.
COMORBIDITIES = (
    ("psychiatric", "74732009", "MHPSYCH"), ("neurological", "118940003", "MH2NEURL"), ("heent", "118934005", "MH3HEAD"), ("cardiovascular", "49601007", "MH4CARD"), ("respiratory", "50043002", "MH5RESP"), ("hepatic", "235856003", "MH6HEPAT"),
    ("dermatological", "95320005", "MH7DERM"), ("musculoskeletal", "928000", "MH8MUSCL"), ("endocrine", "362969004", "MH9ENDO"), ("gastrointestinal", "53619000", "MH10GAST"), ("hematological", "414022008", "MH11HEMA"), ("renal", "42030000", "MH12RENA"),
    ("allergy", "609328004", "MH13ALLE"), ("alcohol_history", "160573003", "MH14ALCH"), ("drug_history", "417662000", "MH15DRUG"), ("smoking_history", "77176002", "MH16SMOK"), ("malignancy", "55342001", "MH17MALI"), ("surgery_history", "161615003", "MH18SURG"),
)
# Laboratory and plasma columns, the last without threshold.
LABORATORY = (
    Analyte("RCT11", "VITAMIN_B12", "pg/mL", "Blood", 200.0, "low"), Analyte("HMT7", "HOMOCYSTEINE", "μmol/L", "Blood", 15.0, "high"), Analyte("RCT392", "CHOLESTEROL", "mg/dL", "Blood", 200.0, "high"), Analyte("DILUTION_CORRECTED_CONC", "PTAU217", "pg/mL", "Plasma", None, "high"),
)


# The fluid panel of its assay.
FLUID = (
    Analyte("ABETA42", "Aβ42", "pg/mL", "CSF", 1100.0, "low"), Analyte("ABETA40", "Aβ40", "pg/mL", "CSF", None, "low"), Analyte("TAU", "Total Tau", "pg/mL", "CSF", 400.0, "high"), Analyte("PTAU", "p-Tau181", "pg/mL", "CSF", 27.0, "high"),
)
GENOTYPE_RISK_ABOVE = 2.0


def _number(df: DataFrame, column: str):
    """A column as a number, null where it isn't there or isn't one."""
    return clean_numeric(F.col(column).cast("string")) if column in df.columns else F.lit(None).cast("double")


def vital_signs(df: DataFrame, vitals: tuple[Vital, ...] = VITALS, visits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of a wide table (PTID, VISCODE2 or VISCODE, the vitals' columns).

    rows: (biomarker_id, visit_id, ptid, type, code, curie, uri, value, unit, source_column, rule_id) of every
    value in its range; weight of unit 1 is pounds and height of unit 1 inches (VSWTUNIT, VSHTUNIT), both
    rounded to two places; BMI comes from the two. With visits (visit_id) only rows of known visits.
    counts: (type, kept, rejected) of all rows with patient and visit, a value that is missing or out of
    range being rejected. Rows without patient or visit are left out; the visit code is in lower case.
    """
    code = next((c for c in ("VISCODE2", "VISCODE") if c in df.columns), None)
    viscode = F.lower(F.trim(F.col(code).cast("string"))) if code else F.lit(None).cast("string")
    weight, height = _number(df, "VSWEIGHT"), _number(df, "VSHEIGHT")
    weight = F.when(_number(df, "VSWTUNIT") == 1, F.round(weight * 0.453592, 2)).otherwise(weight)
    height = F.when(_number(df, "VSHTUNIT") == 1, F.round(height * 2.54, 2)).otherwise(height)
    made = {"VSWEIGHT": weight, "VSHEIGHT": height, VITALS[-1].column: F.when(height > 0, F.round(weight / (height / 100 * (height / 100)), 2))}
    each = F.array(*[F.struct(F.lit(v.name).alias("type"), F.lit(v.code).alias("code"), F.lit(v.unit).alias("unit"), F.lit(v.column).alias("source_column"), made.get(v.column, _number(df, v.column)).alias("value"), F.lit(v.low).alias("low"), F.lit(v.high).alias("high")) for v in vitals])
    long = df.select(F.trim(F.col("PTID").cast("string")).alias("ptid"), viscode.alias("viscode"), F.explode(each).alias("v")).where("ptid <> '' and viscode <> ''").select("ptid", "viscode", "v.*")
    long = long.withColumn("kept", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)))
    visit = F.concat_ws("_", "ptid", "viscode")
    rows = long.where("kept").select(
        F.concat_ws("_", visit, "type").alias("biomarker_id"), visit.alias("visit_id"), "ptid", "type", "code", F.concat(F.lit("LOINC:"), "code").alias("curie"), F.concat(F.lit(CODE_PREFIX), "code").alias("uri"), "value", "unit", "source_column", F.concat(F.lit("vitals_to_loinc:"), "source_column").alias("rule_id"),
    )
    if visits is not None:
        rows = rows.join(visits.select("visit_id").distinct(), "visit_id", "left_semi")
    return rows, long.groupBy("type").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"))


def comorbidities(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = COMORBIDITIES) -> DataFrame:
    """(comorbidity_id, ptid, category, code, curie, rule_id): each category of which a patient has the flag in any row, once.

    A flag is the number 1 or Y. Columns that aren't there count as not set; rows without patient are left out.
    """
    each = F.array_compact(F.array(*[F.when(flag_truthy(F.col(column).cast("string")), F.struct(F.lit(name).alias("category"), F.lit(code).alias("code"), F.lit(column).alias("column"))) for name, code, column in rules if column in df.columns]))
    if not any(column in df.columns for _, _, column in rules):
        each = F.array().cast("array<struct<category:string,code:string,column:string>>")
    rows = df.select(F.trim(F.col("PTID").cast("string")).alias("ptid"), F.explode(each).alias("c")).where("ptid <> ''").select("ptid", "c.*").distinct()
    return rows.select(F.concat_ws("_", "ptid", "category").alias("comorbidity_id"), "ptid", "category", "code", F.concat(F.lit("SNOMED-CT:"), "code").alias("curie"), F.concat(F.lit("medhist_to_snomed:"), "column").alias("rule_id"))


def analytes(df: DataFrame, rules: tuple[Analyte, ...], source: str) -> DataFrame:
    """(biomarker_id, visit_id, ptid, analyte, value, unit, specimen, abnormal, source, source_column): each rule's column of a wide table, one row a number.

    The patient is PTID, else RID; the visit VISCODE2, else VISCODE, else bl. A value beyond its
    threshold in its direction is abnormal, without threshold none is. Texts that are no numbers give no row.
    """
    first = lambda names, other: F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in df.columns], F.lit(other))
    kept = [r for r in rules if r.column in df.columns]
    each = [F.struct(F.lit(r.name).alias("analyte"), _number(df, r.column).alias("value"), F.lit(r.unit).alias("unit"), F.lit(r.specimen).alias("specimen"), F.lit(r.threshold).cast("double").alias("threshold"), F.lit(r.direction).alias("direction"), F.lit(r.column).alias("source_column")) for r in kept]
    empty = "array<struct<analyte:string,value:double,unit:string,specimen:string,threshold:double,direction:string,source_column:string>>"
    long = df.select(first(("PTID", "RID"), None).alias("ptid"), first(("VISCODE2", "VISCODE"), "bl").alias("viscode"), F.explode(F.array(*each) if each else F.array().cast(empty)).alias("a")).select("ptid", "viscode", "a.*").where("ptid is not null and value is not null")
    visit = F.concat_ws("_", "ptid", "viscode")
    return long.select(F.concat_ws("_", F.lit("bio"), visit, "analyte").alias("biomarker_id"), visit.alias("visit_id"), "ptid", "analyte", "value", "unit", "specimen", abnormal_flag(F.col("value"), F.col("threshold"), F.col("direction")).alias("abnormal"), F.lit(source).alias("source"), "source_column")


def genotype_rows(df: DataFrame, source: str) -> DataFrame:
    """(biomarker_id, visit_id, ptid, analyte, value, unit, specimen, abnormal, source, source_column) of genotypes (PTID, GENOTYPE, VISCODE or bl): the risk score of each, abnormal above GENOTYPE_RISK_ABOVE.

    Genotypes are texts like 3/4 or E3/E4. Rows without patient or genotype are left out.
    """
    code = F.coalesce(F.nullif(F.trim(F.col("VISCODE").cast("string")), F.lit("")), F.lit("bl")) if "VISCODE" in df.columns else F.lit("bl")
    rows = df.select(F.nullif(F.trim(F.col("PTID").cast("string")), F.lit("")).alias("ptid"), code.alias("viscode"), F.col("GENOTYPE").cast("string").alias("g")).where("ptid is not null and g is not null")
    risk = genotype_risk(F.col("g"))
    return rows.select(
        F.concat_ws("_", F.lit("bio"), "ptid", F.lit("APOE"), "viscode").alias("biomarker_id"), F.concat_ws("_", "ptid", "viscode").alias("visit_id"), "ptid", F.lit("APOE Genotype").alias("analyte"), risk.alias("value"), F.lit("risk_score").alias("unit"), F.lit("Blood").alias("specimen"),
        (risk > GENOTYPE_RISK_ABOVE).alias("abnormal"), F.lit(source).alias("source"), F.lit("GENOTYPE").alias("source_column"),
    )


def profile_with_diagnoses(tables: dict[str, DataFrame], key: str, words: tuple[str, ...] = ("DIAGNOSIS", "DX")) -> DataFrame:
    """(name, n_rows, n_columns, n_keys, has_diagnosis, diagnosis_columns) of each table; a diagnosis column has one of the words in its name, in any case."""
    parts = []
    for name, df in tables.items():
        found = sorted(c for c in df.columns if any(w in c.upper() for w in words))
        keys = F.count_distinct(key) if key in df.columns else F.lit(None).cast("long")
        parts.append(df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), keys.alias("n_keys"), F.lit(bool(found)).alias("has_diagnosis"), F.lit("|".join(found)).alias("diagnosis_columns")))
    return reduce(DataFrame.unionByName, parts)
