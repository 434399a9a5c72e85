"""Sources and sinks, identity, upserts and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.clean import NULL_TOKENS, cdr_to_diagnosis, clean_string, family_column, indicates_dementia, map_arm, map_diagnosis, normalize_viscode, score_to_diagnosis, valid_patient_id, viscode_to_months

RULE_SCHEMA = "source_table string, source_column string, source_value_pattern string, target_ontology string, target_uri string, target_label string, mapping_rule string, test_fixture_id string, last_verified_date date"


# Columns in the order in which they are tried.
VISIT_COLUMNS = ("VISCODE2", "VISCODE", "VISIT", "VISITNO", "VISITCODE")
PATIENT_COLUMNS = ("PTID", "RID", "SUBJID", "SUBJECT")
DATE_COLUMNS = ("EXAMDATE", "VISITDATE", "USERDATE", "SCANDATE", "EXAMDT", "VISDATE", "DATE")


def read_csv_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every CSV file of a folder by name; null tokens are null, column names stripped, empty tables left out.

    The files are listed by Spark's own reader, so any store that it reads will do.
    """
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()]
    out = {}
    for path in sorted(files):
        df = spark.read.csv(path, header=True)
        df = df.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])
        if df.columns and not df.isEmpty():
            out[path.rsplit("/", 1)[1].removesuffix(".csv")] = df
    return out


def resolve_table(names: list[str], pattern: str, prefix: str = "STUDY_") -> str | None:
    """The name that equals the pattern without cohort prefix and date suffix, else the first that holds it, whatever the case."""
    plain = {n: n.removeprefix(prefix).rsplit("_", 1)[0] if n.rsplit("_", 1)[-1].isdigit() else n.removeprefix(prefix) for n in sorted(names)}
    exact = [n for n, p in plain.items() if p == pattern]
    return next(iter(exact or [n for n in plain if pattern.upper() in n.upper()]), None)


def categorize(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, category): the first rule, by priority, whose word the name holds; else other."""
    hit = names.join(F.broadcast(rules), F.upper("name").contains(F.col("word")), "left")
    return hit.groupBy("name").agg(F.coalesce(F.min_by("category", "priority"), F.lit("other")).alias("category"))


def standardize(df: DataFrame) -> DataFrame:
    """PTID from SUBJID where absent, VISCODE (else VISCODE2) lower-cased and trimmed, all strings cleaned."""
    if "PTID" not in df.columns and "SUBJID" in df.columns:
        df = df.withColumnRenamed("SUBJID", "PTID")
    codes = [c for c in ("VISCODE", "VISCODE2") if c in df.columns]
    if codes:
        df = df.withColumn("VISCODE", F.lower(F.trim(F.coalesce(*codes))))
    return df.withColumns({c: clean_string(F.col(c)) for c, kind in df.dtypes if kind == "string"})


def profile(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(name, n_rows, n_columns, n_keys) of each table."""
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), (F.count_distinct(key) if key in df.columns else F.lit(None).cast("long")).alias("n_keys")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """(column, value, n) of the k commonest values of each column."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    counted = df.select(each).select("x.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("k") <= k).drop("k")


def wide_to_entities(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(entity, key, value) rows of a wide table, one for each non-null column; columns maps a column to its entity."""
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("entity"), F.col(c).cast("string").alias("value")) for c, e in columns.items()])).alias("x")
    return df.select(F.col(key).alias("key"), each).select("x.entity", "key", "x.value").where("value is not null")


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Mapping rules of a folder of CSV files with a file column; rows without the common columns are left out by the schema."""
    return spark.read.csv(folder, header=True, schema=RULE_SCHEMA).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def read_json_dictionary(spark: SparkSession, path: str, value: str = "struct<label:string,parent:string>") -> DataFrame:
    """(code, label, parent, resolved_via) of a JSON object keyed by code."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return text.select(F.explode("m").alias("code", "v")).select("code", "v.*", F.lit("dictionary").alias("resolved_via"))


def parse_node_lines(lines: DataFrame, kinds: list[str], keyword: str, most: int = 200, prefix: str = "kb:") -> DataFrame:
    """(kind, label, id) of CREATE lines whose label property holds the keyword, the first most by id."""
    kind = F.regexp_extract("value", rf"\(\w*:({'|'.join(kinds)})\b", 1)
    label = F.regexp_extract("value", r"""label\s*:\s*["']([^"']*)["']""", 1)
    rows = lines.select(kind.alias("kind"), label.alias("label")).where((F.col("kind") != "") & F.lower("label").contains(keyword))
    return rows.withColumn("id", F.concat(F.lit(prefix), "kind", F.lit("_"), F.substring("label", 1, 40))).distinct().orderBy("id").limit(most)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def image_inventory(df: DataFrame) -> DataFrame:
    """(path, length, kind) of listed files that are images: by suffix, or by the mark DICM at byte 128 of large files without one."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    marked = ~name.contains(".") & (F.col("length") > 100_000) & (F.substring(F.col("content"), 129, 4) == F.lit(b"DICM"))
    low = F.lower(name)
    kind = F.when(low.rlike(r"\.(dcm|ima)$") | marked, "dicom").when(low.rlike(r"\.nii(\.gz)?$"), "nifti")
    return df.where(~name.startswith(".")).select("path", "length", kind.alias("kind")).where("kind is not null")


def write_entities(df: DataFrame, folder: str, label: str = "label") -> None:
    df.write.partitionBy(label).mode("overwrite").parquet(folder)


def new_documents(rows: DataFrame, known: DataFrame, key: str, date: str) -> DataFrame:
    """Rows whose key isn't known, one a key, with the date column as a date or null."""
    fresh = rows.join(known.select(key), key, "left_anti").dropDuplicates([key])
    return fresh.withColumn(date, F.col(date).try_cast("date"))


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of the sorted non-null columns that don't begin with an underscore, as JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if not c.startswith("_")))), 256)


def member_id(*parts: Column) -> Column:
    return F.concat(F.lit("fm_"), F.substring(F.md5(F.concat_ws("_", *parts)), 1, 12))


def file_identity(path: Column, size: Column, mtime: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", path, size.cast("string"), mtime.cast("string"))), 1, 16)


def merge_upsert(old: DataFrame, new: DataFrame, key: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """All rows by key: old values stay, new ones fill nulls, list columns are united (old first). Both sides have one row a key."""
    names = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    both = lambda c: F.array_union(F.coalesce(f"o.{c}", F.array()), F.coalesce(f"n.{c}", F.array())) if c in lists else F.coalesce(f"o.{c}", f"n.{c}")
    return joined.select(key, *[both(c).alias(c) for c in names])


def merge_if_changed(old: DataFrame, new: DataFrame, key: str, digest: str = "_hash", keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """All rows by key: the new row where the hash differs from the old one's, but for the columns in keep."""
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer")
    change = F.col("_new").isNotNull() & (F.col("_old").isNull() | ~F.col(f"o.{digest}").eqNullSafe(F.col(f"n.{digest}")))
    value = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.when(change, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(key, *[value(c).alias(c) for c in old.columns if c != key])


def ledger(rows: DataFrame) -> DataFrame:
    """(batch, table, total_rows, written_rows) of rows with _batch_id, _source_table and _written."""
    return rows.groupBy("_batch_id", "_source_table").agg(F.count("*").alias("total_rows"), F.count_if("_written").alias("written_rows"))


def required_split(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns, and the others."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    return df.where(full), df.where(~full)


def referenced_missing(facts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that facts refer to and known lacks, with the subject id in them."""
    keys = facts.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
    return keys.withColumn("subject", F.regexp_extract(key, r"^(\d{3}_S_\d{4})", 1))


def crosswalk(tables: list[DataFrame], a: str, b: str) -> DataFrame:
    """(a, b) of every table that has both; the last table wins."""
    rows = [df.select(a, b, F.lit(k).alias("_k")) for k, df in enumerate(tables) if {a, b} <= set(df.columns)]
    return reduce(DataFrame.unionByName, rows).where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.max_by(b, F.struct("_k", b)).alias(b))


def attributes(tables: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """One row a key: each column's last non-null value in table order, and the indices of its tables."""
    rows = [df.select(key, *[(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in columns], F.lit(k).alias("_k")) for k, df in enumerate(tables)]
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_k", c))).alias(c) for c in columns], F.array_sort(F.collect_set("_k")).alias("tables"))


def universe(tables: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """Distinct ids over all of the key columns of all tables."""
    rows = [df.select(F.col(k).cast("string").alias("id")) for df in tables for k in keys if k in df.columns]
    return reduce(DataFrame.unionByName, rows).where("id is not null").distinct()


def visits_of(tables: dict[str, DataFrame], crosswalk: DataFrame | None = None) -> DataFrame:
    """(visit_id, ptid, viscode, months, visit_date, visit_type, sources): one row a patient and visit of all tables.

    A table counts by the first of the visit and of the patient columns that it has; RID values become PTID by the crosswalk
    (RID, PTID) where it has them; rows without either, or with an id that isn't valid, are left out. The date is that of the
    first table with one, there of the first date column filled, the least of equal ones; sources are the tables' names.
    """
    rows = []
    for k, (name, df) in enumerate(tables.items()):
        visit, patient = (next((c for c in columns if c in df.columns), None) for columns in (VISIT_COLUMNS, PATIENT_COLUMNS))
        if visit is None or patient is None:
            continue
        dates = [F.col(c).cast("string") for c in DATE_COLUMNS if c in df.columns]
        at = F.coalesce(*dates) if dates else F.lit(None).cast("string")
        part = df.select(F.trim(F.col(patient).cast("string")).alias("ptid"), normalize_viscode(F.trim(F.col(visit).cast("string"))).alias("viscode"), at.alias("at"), F.lit(k).alias("k"), F.lit(name).alias("source"))
        if patient == "RID" and crosswalk is not None:
            known = crosswalk.select(F.col("RID").cast("string").alias("ptid"), F.col("PTID").alias("_ptid"))
            part = part.join(known, "ptid", "left").withColumn("ptid", F.coalesce("_ptid", "ptid")).drop("_ptid")
        rows.append(part)
    every = reduce(DataFrame.unionByName, rows).where(F.col("viscode").isNotNull() & valid_patient_id(F.col("ptid")))
    first = F.min(F.when(F.col("at").isNotNull(), F.struct("k", "at")))["at"]
    one = every.groupBy("ptid", "viscode").agg(first.alias("visit_date"), F.array_sort(F.collect_set("source")).alias("sources"))
    kind = F.when(F.col("viscode").isin("bl", "sc"), "baseline").otherwise("follow-up")
    return one.select(F.concat_ws("_", "ptid", "viscode").alias("visit_id"), "ptid", "viscode", viscode_to_months(F.col("viscode")).alias("months"), "visit_date", kind.alias("visit_type"), "sources")


def diagnoses_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(diagnosis_id, ptid, viscode, code, confidence, source) of those of the tables DXSUM, ARM, BLCHANGE, CDR and MMSE that are given.

    DXSUM: DIAGNOSIS, else the flags DXAD, DXMCI (with DXMDES 1 EMCI, 2 LMCI) and DXNORM in this order; DXCONFID 1, 2, 3 is
    0.95, 0.75, 0.5, else 0.95. ARM counts as visit screening with 1.0, BLCHANGE (BCPREDX) 0.85, CDR (CDGLOBAL: 0 CN, up to
    0.5 MCI, from 1 AD) 0.8, MMSE (MMSCORE) 0.75. The visit is VISCODE2, else VISCODE, else bl. Rows without patient or code are left out.
    """

    def have(df: DataFrame, name: str, kind: str = "string"):
        return F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)

    def flags(df: DataFrame) -> Column:
        mild = F.when(have(df, "DXMDES", "int") == 1, "EMCI").when(have(df, "DXMDES", "int") == 2, "LMCI").otherwise("MCI")
        return F.when(have(df, "DXAD", "int") == 1, "AD").when(have(df, "DXMCI", "int") == 1, mild).when(have(df, "DXNORM", "int") == 1, "CN")

    def sure(df: DataFrame) -> Column:
        return F.when(have(df, "DXCONFID", "int") == 2, 0.75).when(have(df, "DXCONFID", "int") == 3, 0.5).otherwise(0.95)

    def rated(df: DataFrame) -> Column:
        return cdr_to_diagnosis(have(df, "CDGLOBAL", "double"))

    always = lambda x: lambda df: F.lit(x)
    rules = {
        "DXSUM": (lambda df: F.coalesce(map_diagnosis(have(df, "DIAGNOSIS")), flags(df)), sure, ""),
        "ARM": (lambda df: map_arm(have(df, "ARM")), always(1.0), ""),
        "BLCHANGE": (lambda df: map_diagnosis(have(df, "BCPREDX")), always(0.85), "_predicted"),
        "CDR": (rated, always(0.8), "_CDR"),
        "MMSE": (lambda df: score_to_diagnosis(have(df, "MMSCORE", "double")), always(0.75), "_MMSE"),
    }
    rows = []
    for name, (code, confidence, mark) in rules.items():
        if name in tables:
            df = tables[name]
            visit = F.lit("screening") if name == "ARM" else F.trim(next((F.col(c).cast("string") for c in VISIT_COLUMNS[:2] if c in df.columns), F.lit("bl")))
            rows.append(df.select(F.trim(F.col("PTID").cast("string")).alias("ptid"), visit.alias("viscode"), code(df).alias("code"), confidence(df).cast("double").alias("confidence"), F.lit(name).alias("source"), F.lit(mark).alias("mark")))
    every = reduce(DataFrame.unionByName, rows).where("ptid <> '' and code is not null")
    return every.select(F.concat(F.lit("dx_"), F.concat_ws("_", "ptid", "viscode", "code"), "mark").alias("diagnosis_id"), "ptid", "viscode", "code", "confidence", "source")


def range_check(rows: DataFrame, rules: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """rows of measurements with ``in_range``: whether the value lies within the low and high that rules (name, low, high) have for it; null without value or rule."""
    rule = F.broadcast(rules.select(F.col("name").alias("_name"), "low", "high"))
    return rows.join(rule, F.col(name) == F.col("_name"), "left").withColumn("in_range", F.col(value).between(F.col("low"), F.col("high"))).drop("_name", "low", "high")


def range_counts(checked: DataFrame, name: str = "name") -> DataFrame:
    """(name, kept, rejected, missing) of range-checked rows."""
    return checked.groupBy(name).agg(F.count_if("in_range").alias("kept"), F.count_if(~F.col("in_range")).alias("rejected"), F.count_if(F.col("in_range").isNull()).alias("missing"))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value).where(F.col(value).isNotNull())


def family_members(df: DataFrame, key: str) -> DataFrame:
    """(key, relation, member): positive family-history columns of a wide table, the first of each relation by column name."""
    columns = [c for c in df.columns if c != key]
    long = df.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(key, columns, "column", "value")
    rows = long.withColumn("relation", family_column(F.col("column"))).where(F.col("relation").isNotNull() & indicates_dementia(F.col("value")))
    first = rows.groupBy(key, "relation").agg(F.min("column").alias("column"))
    return first.select(key, "relation", member_id(F.col(key).cast("string"), F.col("relation"), F.col("column")).alias("member"))


def generic_findings(df: DataFrame, key: str, source: str) -> DataFrame:
    """(id, key, scores map, notes map, confidence) of any table: numbers to scores, other texts (cut at 500, none beyond 1000) to notes."""
    cols = [c for c in df.columns if c != key]
    text = F.map_filter(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull() & (F.char_length(v) <= 1000))
    rows = df.select(F.col(key).alias("key"), text.alias("m"))
    scores = F.transform_values(F.map_filter("m", lambda _, v: v.try_cast("double").isNotNull()), lambda _, v: v.cast("double"))
    notes = F.transform_values(F.map_filter("m", lambda _, v: v.try_cast("double").isNull()), lambda _, v: F.substring(v, 1, 500))
    return rows.select(F.sha2(F.concat_ws("|", F.lit(source), F.col("key").cast("string"), F.to_json("m")), 256).alias("id"), "key", scores.alias("scores"), notes.alias("notes"), F.least(F.lit(1.0), F.size("m") / 10).alias("confidence"))
