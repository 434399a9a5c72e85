"""Entities of a second cohort's wide sessions, entity tables with provenance, and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.functions.clean import cdr_to_diagnosis_of_two
from strandline.sources.tables import row_hash

# The wide table's columns by entity kind, as property -> column.
SESSION_COLUMNS = {
    "Patient": {"sex": "M/F", "hand": "Hand", "educ": "EDUC", "ses": "SES"},
    "Visit": {"viscode": "Visit", "age": "Age", "mr_delay": "MR Delay", "group": "Group"},
    "BrainRegion": {"nwbv": "nWBV", "etiv": "eTIV", "asf": "ASF"},
}
WHOLE_BRAIN = "Whole Brain"
#: Rows of an exported list at most.
EXPORTED = 100


def session_entities(sessions: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of wide rows, one for each imaging session of a subject.

    entities (kind, key, properties map, source): a Patient by Subject ID; a Visit by MRI ID; for each
    visit, only where its value is there, a Diagnosis (CDR 0 CN, else AD, with cdr and group), a
    CognitiveAssessment of MMSE and one of CDR, and the Whole Brain's BrainRegion (where nWBV is there).
    edges (src, type, dst): HAS_VISIT, HAS_DIAGNOSIS, HAS_COGNITIVE_ASSESSMENT, HAS_IMAGE. Rows without
    MRI ID are left out, and patients and their edges where there is no Subject ID. A key that comes more than
    once is one entity: of each property the greatest text, so that the order of rows does not matter.
    Properties without value are not in the map; values are trimmed, empty ones are none.
    """
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) if c in sessions.columns else F.lit(None).cast("string")
    rows = sessions.select(text("Subject ID").alias("_subject"), text("MRI ID").alias("_visit"), text("CDR").alias("_cdr"), text("MMSE").alias("_mmse"), *[text(c).alias(f"{kind}.{p}") for kind, columns in SESSION_COLUMNS.items() for p, c in columns.items()]).where("_visit is not null")
    cdr = F.col("_cdr").try_cast("double")

    visit, mmse, region = F.col("_visit"), F.col("_mmse").isNotNull(), F.col("`BrainRegion.nwbv`").isNotNull()

    def of(kind: str, there: Column) -> dict[str, Column]:
        return {f"{kind}.{p}": F.when(there, F.col(f"`{kind}.{p}`")) for p in SESSION_COLUMNS[kind]}

    # rows meet once by subject and once by visit, whose key is in the keys of all its kinds; entities are made then
    subject = of("Patient", F.lit(True))
    session = {
        **of("Visit", F.lit(True)), **of("BrainRegion", region), "MMSE.value": F.col("_mmse"), "CDR.value": F.when(cdr.isNotNull(), F.col("_cdr")),
        "Diagnosis.diagnosis_code": cdr_to_diagnosis_of_two(cdr), "Diagnosis.group": F.when(cdr.isNotNull(), F.col("`Visit.group`")),
    }
    names = [*subject, *session]

    def row(of_visit: bool, key: Column, mine: dict[str, Column]) -> Column:
        values = [mine.get(n, F.lit(None)).cast("string").alias(n) for n in names]
        return F.when(key.isNotNull(), F.struct(F.lit(of_visit).alias("of_visit"), key.alias("key"), *values))

    each = rows.select(F.explode(F.array_compact(F.array(row(False, F.col("_subject"), subject), row(True, visit, session)))).alias("e")).select("e.*")
    best = each.groupBy("of_visit", "key").agg(*[F.max(f"`{n}`").alias(n) for n in names])
    key, test = F.col("key"), lambda key, name: F.concat_ws("_", key, F.lit(name))

    def entity(kind: str, key: Column, pairs: dict[str, Column], there: Column) -> Column:
        every = F.create_map(*[x for p in sorted(pairs) for x in (F.lit(p), pairs[p])])
        return F.when(there, F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.map_filter(every, lambda _, v: v.isNotNull()).alias("properties")))

    kept = lambda kind: {p: F.col(f"`{kind}.{p}`") for p in SESSION_COLUMNS[kind]}
    score, scale = F.col("`CDR.value`"), F.col("`MMSE.value`")
    made = F.array(
        entity("Patient", key, kept("Patient"), ~F.col("of_visit")), entity("Visit", key, kept("Visit"), F.col("of_visit")),
        entity("Diagnosis", F.concat(F.lit("dx_"), key), {"diagnosis_code": F.col("`Diagnosis.diagnosis_code`"), "cdr": score, "group": F.col("`Diagnosis.group`")}, score.isNotNull()),
        entity("CognitiveAssessment", test(key, "MMSE"), {"test_name": F.lit("MMSE"), "value": scale}, scale.isNotNull()), entity("CognitiveAssessment", test(key, "CDR"), {"test_name": F.lit("CDR"), "value": score}, score.isNotNull()),
        entity("BrainRegion", test(key, WHOLE_BRAIN), {"name": F.lit(WHOLE_BRAIN), **kept("BrainRegion")}, F.col("`BrainRegion.nwbv`").isNotNull()),
    )
    one = best.select(F.explode(F.array_compact(made)).alias("e")).select("e.*")
    dx = F.concat(F.lit("dx_"), visit)
    edge = lambda kind, dst, there, src=visit: F.when(there, F.struct(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst")))
    linked = F.array(
        edge("HAS_VISIT", visit, F.col("_subject").isNotNull(), F.col("_subject")), edge("HAS_DIAGNOSIS", dx, cdr.isNotNull()), edge("HAS_COGNITIVE_ASSESSMENT", test(visit, "MMSE"), mmse),
        edge("HAS_COGNITIVE_ASSESSMENT", test(visit, "CDR"), cdr.isNotNull()), edge("HAS_IMAGE", test(visit, WHOLE_BRAIN), region),
    )
    return one.withColumn("source", F.lit(source)), rows.select(F.explode(F.array_compact(linked)).alias("e")).select("e.*").distinct()


def with_provenance(rows: DataFrame, batch_id: str, source_table: str) -> DataFrame:
    """rows with _hash (of the other columns that don't begin with an underscore), _batch_id and _source_table; columns of these names are replaced."""
    plain = rows.drop("_hash", "_batch_id", "_source_table")
    return plain.withColumns({"_hash": row_hash(plain), "_batch_id": F.lit(batch_id), "_source_table": F.lit(source_table)})


def write_entity_tables(tables: dict[str, tuple[DataFrame, str]], folder: str, batch_id: str, required: dict[str, list[str]] | None = None) -> DataFrame:
    """Write each kind's rows (rows, source table) with provenance to folder/kind/batch; returns (kind, source_table, total_rows, written_rows, batch_id).

    Rows that lack a required column, and repeats of a row by its hash, are not written. A batch that is
    written again replaces itself, so a step may be repeated; other batches stay. Each kind is one job: rows
    are counted as they pass and dealt by their own columns, and the long hash is made where they arrive.
    """
    spark, done = next(iter(tables.values()))[0].sparkSession, []
    for kind, (rows, source) in tables.items():
        full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (required or {}).get(kind, [])], F.lit(True))
        seen, place = Observation(), f"{folder}/{kind}/batch={batch_id}"
        own = [c for c in rows.columns if not c.startswith("_")]
        # equal hashes are of equal columns, so rows dealt by these need no exchange by the hash
        dealt = rows.observe(seen, F.count(F.lit(1)).alias("n")).where(full).repartition(*own)
        with_provenance(dealt, batch_id, source).dropDuplicates([*own, "_hash"]).write.mode("overwrite").option("compression", "zstd").parquet(place)
        done.append((kind, source, seen.get["n"], spark.read.parquet(place).count(), batch_id))
    return spark.createDataFrame(done, "kind string, source_table string, total_rows long, written_rows long, batch_id string")


def export_json(rows: DataFrame, folder: str, order: list[str], most: int = EXPORTED) -> None:
    """The first ``most`` rows by order as JSON lines, nulls as nulls."""
    rows.orderBy(*order).limit(most).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def export_audit(steps: DataFrame, folder: str) -> None:
    """Audit rows as CSV with a header: texts quoted where needed, lists joined by a bar, nulls empty."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in steps.dtypes]
    steps.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def metric_report(parts: dict[str, DataFrame]) -> DataFrame:
    """(report): one JSON object with a list of each part's rows, sorted; nulls are left out. Parts are metrics, one row a label or check, and pass one task."""
    columns = []
    frame = None
    for name, rows in parts.items():
        one = rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))
        frame = one if frame is None else frame.crossJoin(one)
        columns.append(name)
    return frame.select(F.to_json(F.struct(*columns)).alias("report"))
