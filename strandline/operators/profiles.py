"""Clinical profiles, event kinds and report tables whose rules are data: risk factors, phenotypes, pathways, findings, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.clean import cases

# Analyte names by pathway, tracers by pathway, strengths; event categories by word; ATN stages; message kinds by word.
PATHWAYS = (
    ("amyloid_cascade", ("Aβ42", "ABETA42", "AB42", "Aβ40", "ABETA40", "AB40")), ("tau_pathology", ("Total Tau", "TAU", "T-TAU", "TTAU")), ("tau_pathology", ("p-Tau181", "PTAU", "P-TAU", "PTAU181")), ("neurodegeneration", ("Total Tau", "TAU", "T-TAU")),
)
TRACER_PATHWAYS = {"AV45": "amyloid_cascade", "PIB": "amyloid_cascade", "FBB": "amyloid_cascade", "AV1451": "tau_pathology", "FDG": "neurodegeneration"}
ABNORMAL_STRENGTH, NORMAL_STRENGTH = 0.9, 0.3
EVENT_CATEGORIES = (("DIAGNOSIS|CONVERSION", "clinical"), ("BIOMARKER|ATN", "biomarker"), ("COGNITIVE", "cognitive"), ("IMAGING", "imaging"), ("TREATMENT", "treatment"))
ATN_STAGES = {"A+/T+/N+": "full_ad_pathology", "A+/T+/N-": "ad_pathologic_change", "A+/T-/N-": "preclinical_ad", "A-/T+/N+": "non_ad_pathology"}
ERROR_KINDS = (("not found", "FILE_NOT_FOUND"), ("pixel", "PIXEL_VALIDATION_ERROR"), ("metadata", "METADATA_ERROR"), ("tiff", "TIFF_GENERATION_ERROR"))
# stages in the order of progression, and severities of a diagnosis by stage
STAGE_LADDER = ("preclinical", "mci", "mild_ad", "moderate_ad", "severe_ad")
SEVERITY_STAGES = {"severe_impairment": "severe_ad", "moderate_impairment": "moderate_ad", "mild_impairment": "mci"}
WARNING_KINDS = (("missing metadata fields", "INCOMPLETE_METADATA"), ("not found", "OPTIONAL_FILE_MISSING"), ("upscale", "UPSCALING_ISSUE"), ("thumbnail", "THUMBNAIL_ISSUE"))


def risk_factors(patients: DataFrame, members: DataFrame, key: str = "pid", oldest: int = 75) -> DataFrame:
    """(key, factor, level): APOE4 by genotype (two alleles 4 very_high, one high), AGE over ``oldest`` and FAMILY_HISTORY of a member with dementia, both moderate.

    patients: key, genotype, age; members: key, has_dementia. A patient has each factor once, whatever the
    number of members or of rows; nulls say nothing.
    """
    own = F.array_compact(F.array(
        F.when(F.col("genotype").contains("4"), F.struct(F.lit("APOE4").alias("factor"), F.when(F.regexp_replace("genotype", "E", "").contains("4/4"), "very_high").otherwise("high").alias("level"))),
        F.when(F.col("age") > oldest, F.struct(F.lit("AGE").alias("factor"), F.lit("moderate").alias("level"))),
    ))
    given = patients.select(key, F.explode(own).alias("f")).select(key, "f.*").distinct()
    history = members.where("has_dementia").join(patients.select(key), key, "left_semi").select(key, F.lit("FAMILY_HISTORY").alias("factor"), F.lit("moderate").alias("level")).distinct()
    return given.unionByName(history)


def phenotypes(stages: DataFrame, amyloid: DataFrame, courses: DataFrame, key: str = "pid") -> DataFrame:
    """(key, phenotype, has_stage, has_atn, has_course) by the first rule that holds; patients that none fits are left out.

    stages: key, stage; amyloid: key, status (A+ or A-); courses: key, course (declining, stable ...), each
    one row a patient. Both are optional, the stage is not: every rule names one.
    """
    s, a, c = F.col("stage"), F.col("status"), F.col("course")
    mild = s.isin("EMCI", "LMCI")
    kind = cases([
        ((s == "AD") & (a == "A+"), F.lit("typical_ad")), ((s == "AD") & (a == "A-"), F.lit("snap")), (mild & (c == "declining"), F.lit("progressive_mci")), (mild & (c == "stable"), F.lit("stable_mci")),
        ((s == "CN") & (a == "A+"), F.lit("preclinical_ad")), (s == "AD", F.lit("ad_unspecified")), (mild, F.lit("mci_unspecified")), (s == "CN", F.lit("control")),
    ])
    rows = stages.select(key, "stage").join(amyloid.select(key, "status"), key, "left").join(courses.select(key, "course"), key, "left")
    return rows.select(key, kind.alias("phenotype"), s.isNotNull().alias("has_stage"), a.isNotNull().alias("has_atn"), c.isNotNull().alias("has_course")).where("phenotype is not null")


def pathway_links(facts: DataFrame, row_id: str, images: DataFrame | None = None, image_id: str = "image_id") -> DataFrame:
    """(id, pathway, strength): facts (analyte, abnormal) that indicate a pathway, 0.9 if abnormal else 0.3; images (tracer) that show one, without strength.

    Total tau indicates two pathways. Rows of one id, pathway and strength are one; other analytes and tracers give none.
    """
    rules = [(name, pathway) for pathway, names in PATHWAYS for name in names]
    rule = facts.sparkSession.createDataFrame(rules, "analyte string, pathway string")
    strength = F.when(F.coalesce(F.col("abnormal").cast("boolean"), F.lit(False)), ABNORMAL_STRENGTH).otherwise(NORMAL_STRENGTH)
    links = facts.join(F.broadcast(rule), "analyte").select(F.col(row_id).cast("string").alias("id"), "pathway", strength.alias("strength")).distinct()
    if images is None:
        return links
    shown = images.sparkSession.createDataFrame(list(TRACER_PATHWAYS.items()), "tracer string, pathway string")
    return links.unionByName(images.join(F.broadcast(shown), "tracer").select(F.col(image_id).cast("string").alias("id"), "pathway", F.lit(None).cast("double").alias("strength")).distinct())


def diagnosis_findings(diagnoses: DataFrame, patients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, edges) of diagnoses (diagnosis_id, ptid, code, text, confidence).

    findings: (finding_id, type, code, text, confidence), one a diagnosis, confidence 1 where there is none;
    edges (src, type, dst): IS_CLINICAL_FINDING from each diagnosis, HAS_CLINICAL_FINDING from its patient
    where that is known. Diagnoses without id are left out, repeats give one.
    """
    rows = diagnoses.where("diagnosis_id is not null").withColumn("finding_id", F.concat(F.lit("cf_"), "diagnosis_id"))
    findings = rows.groupBy("finding_id").agg(F.min(F.struct("code", "text", F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"))).alias("f")).select("finding_id", F.lit("Diagnosis").alias("type"), "f.*")
    own = rows.select(F.col("diagnosis_id").cast("string").alias("src"), F.lit("IS_CLINICAL_FINDING").alias("type"), F.col("finding_id").alias("dst"))
    whose = rows.join(patients.select("ptid"), "ptid", "left_semi").select(F.col("ptid").cast("string").alias("src"), F.lit("HAS_CLINICAL_FINDING").alias("type"), F.col("finding_id").alias("dst"))
    return findings, own.unionByName(whose).distinct()


def test_types(assessments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(types, edges) of assessments (id, test_name): one node a name, and an IS_TYPE edge from each assessment. Null names give neither."""
    named = assessments.where("test_name is not null")
    return named.select(F.col("test_name").alias("name")).distinct(), named.select(F.col("id").alias("src"), F.lit("IS_TYPE").alias("type"), F.col("test_name").alias("dst")).distinct()


def event_category(kind: Column) -> Column:
    """The category of the first word that an event's type holds, else other; null for null."""
    return F.when(kind.isNotNull(), cases([(kind.rlike(p), F.lit(c)) for p, c in EVENT_CATEGORIES], F.lit("other")))


def atn_stage(profile: Column) -> Column:
    """The stage of a profile like A+/T-/N-; other for such without a stage of their own, null for null."""
    return F.when(profile.isNotNull(), cases([(profile == p, F.lit(s)) for p, s in ATN_STAGES.items()], F.lit("other")))


def atn_events(profiles: DataFrame) -> DataFrame:
    """(event_id, event_type, ptid, profile, stage) of each patient's profile (ptid, profile); one event a patient and stage, of its least profile."""
    rows = profiles.where("profile is not null").withColumn("stage", atn_stage(F.col("profile")))
    one = rows.groupBy("ptid", "stage").agg(F.min("profile").alias("profile"))
    return one.select(F.concat_ws("_", F.col("ptid").cast("string"), F.lit("atn_transition"), "stage").alias("event_id"), F.lit("ATN_TRANSITION").alias("event_type"), "ptid", "profile", "stage")


def grounded_instances(concepts: DataFrame, edges: DataFrame, types: list[str], sources: list[str] | None = None) -> DataFrame:
    """(source, concepts, grounded, ratio): by source the number of concepts (id, source) and of distinct nodes that edges of these types ground in them, and how many of these a concept has (null without concepts).

    Concepts themselves don't count as instances. All sources come from one join and two counts, listed
    ones also without rows; instances are counted by (source, node) before the count, so a concept of a
    third of all edges costs one row a node.
    """
    known = concepts.select("id", "source").distinct()
    hits = edges.where(F.col("type").isin(types)).select("src", F.col("dst").alias("id")).join(known, "id").select("source", "src").distinct().join(known.select(F.col("id").alias("src")), "src", "left_anti")
    parts = [known.groupBy("source").agg(F.count_distinct("id").alias("concepts"), F.lit(0).cast("long").alias("grounded")), hits.groupBy("source").agg(F.lit(0).cast("long").alias("concepts"), F.count("*").alias("grounded"))]
    if sources:
        parts.append(concepts.sparkSession.createDataFrame([(s, 0, 0) for s in sources], "source string, concepts long, grounded long"))
    both = reduce(DataFrame.unionByName, parts).groupBy("source").agg(F.sum("concepts").alias("concepts"), F.sum("grounded").alias("grounded"))
    both = both.where(F.col("source").isin(sources)) if sources else both
    return both.withColumn("ratio", F.round(F.col("grounded") / F.nullif("concepts", F.lit(0)), 6))


def alignment(external: DataFrame, edges: DataFrame, strong: str = "SAME_AS") -> DataFrame:
    """(category, total, matched, strong, share): external concepts (id, category) that any edge links, and that one of the strong type does; share is that of strong ones, and the category null is all."""
    linked = edges.groupBy(F.col("src").alias("id")).agg(F.bool_or(F.col("type") == strong).alias("_strong"))
    rows = external.select("id", "category").distinct().join(linked, "id", "left")
    each = rows.unionByName(rows.withColumn("category", F.lit(None).cast("string")))
    found = each.groupBy("category").agg(F.count("*").alias("total"), F.count("_strong").alias("matched"), F.count_if("_strong").alias("strong"))
    return found.withColumn("share", F.round(F.coalesce(F.col("strong") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6))


def family_report(members: DataFrame, patients: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n): orphaned members, parent edges without their inverse, circular paths of 2 to 4 parent edges, and members by dementia status.

    members: id, ptid, has_dementia; patients: ptid; edges: src, type (HAS_PARENT, HAS_CHILD ...), dst.
    """
    from strandline.operators.graph import circular_paths, missing_inverses

    count = lambda rows, name: rows.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    status = F.when(F.col("has_dementia"), "with").when(~F.col("has_dementia"), "without").otherwise("unknown")
    by = members.sparkSession.createDataFrame([(f"members_{s}", 0) for s in ("with", "without", "unknown")], "check string, n long")
    parts = [
        count(members.join(patients.select("ptid"), "ptid", "left_anti"), "orphaned_members"), count(missing_inverses(edges.where("type = 'HAS_PARENT'").unionByName(edges.where("type = 'HAS_CHILD'")), {"HAS_PARENT": "HAS_CHILD"}), "one_way_parents"),
        count(circular_paths(edges.where("type = 'HAS_PARENT'").select("src", "dst"), 4), "circular_paths"), members.groupBy(F.concat(F.lit("members_"), status).alias("check")).agg(F.count("*").alias("n")).unionByName(by).groupBy("check").agg(F.sum("n").alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def processing_report(rows: DataFrame, formats: list[str], status: str = "status", done: str = "completed") -> DataFrame:
    """(measure, value) of processed files: their number, by status (null: unknown), the share done, and for each format column the share that has it."""
    n = F.count("*")
    share = lambda c: F.round(F.coalesce(F.count_if(c) / F.nullif(n, F.lit(0)), F.lit(0.0)), 6)
    one = rows.agg(n.cast("double").alias("total"), share(F.col(status) == done).alias("success_rate"), *[share(F.col(f)).alias(f"has_{f}") for f in formats])
    by = rows.groupBy(F.concat(F.lit("status_"), F.coalesce(status, F.lit("unknown"))).alias("measure")).agg(n.cast("double").alias("value"))
    return one.unpivot([], one.columns, "measure", "value").unionByName(by)


def _kind(message: Column, rules: tuple[tuple[str, str], ...], other: str) -> Column:
    return cases([(F.lower(message).contains(word), F.lit(kind)) for word, kind in rules], F.lit(other))


def validation_report(results: DataFrame, rates: list[str], by: str = "modality") -> DataFrame:
    """(by, total, passed, warned, failed, <rate>...) of results (errors and warnings arrays, boolean rate columns), by group and over all (by null).

    A result with errors fails, else one with warnings is warned, else it passes; null arrays are empty.
    Rates are percentages of the results of which the column is true.
    """
    errors, warnings = (F.coalesce(F.size(c), F.lit(0)) > 0 for c in ("errors", "warnings"))
    rows = results.select(F.col(by).alias("_by"), F.when(errors, "failed").when(warnings, "warned").otherwise("passed").alias("_as"), *rates)
    each = rows.unionByName(rows.withColumn("_by", F.lit(None).cast(rows.schema["_by"].dataType)).withColumn("_all", F.lit(True)), allowMissingColumns=True)
    counts = [F.count_if(F.col("_as") == s).alias(s) for s in ("passed", "warned", "failed")]
    # results without a group are a group of their own, beside all
    return each.groupBy("_by", F.coalesce("_all", F.lit(False)).alias("is_all")).agg(F.count("*").alias("total"), *counts, *[F.round(100 * F.count_if(r) / F.count("*"), 6).alias(r) for r in rates]).withColumnRenamed("_by", by)


def issue_report(results: DataFrame, critical: float = 0.1, warning: float = 0.2) -> DataFrame:
    """(severity, type, n, pct, notable): errors and warnings of results by kind of message; notable are errors of more than ``critical``, warnings of more than ``warning`` of the results.

    pct is a percentage of all results, and as a result may have several messages of a kind it may exceed 100.
    """
    total = results.agg(F.count("*").alias("total"))
    each = lambda column, rules, name, severity: results.select(F.explode(column).alias("m")).where("m is not null").groupBy(_kind(F.col("m"), rules, f"UNKNOWN_{name}").alias("type")).agg(F.count("*").alias("n")).withColumn("severity", F.lit(severity))
    both = each("errors", ERROR_KINDS, "ERROR", "error").unionByName(each("warnings", WARNING_KINDS, "WARNING", "warning"))
    limit = F.when(F.col("severity") == "error", critical).otherwise(warning)
    return both.crossJoin(F.broadcast(total)).select("severity", "type", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"), (F.col("n") > limit * F.col("total")).alias("notable"))


def look_up(images: DataFrame, patient: str | None = None, digest: str | None = None, **criteria) -> DataFrame:
    """images (ptid, hash, ...) of a patient, with a hash, and that fit all criteria: a value, a list of values, or (low, high) with None for an open end."""
    rows = images
    for column, want in {"ptid": patient, "hash": digest, **criteria}.items():
        if want is None:
            continue
        c = F.col(column)
        if isinstance(want, tuple):
            low, high = want
            rows = rows.where(c >= low) if low is not None else rows
            rows = rows.where(c <= high) if high is not None else rows
        else:
            rows = rows.where(c.isin(want) if isinstance(want, list) else c == want)
    return rows


def roi_quality(rows: DataFrame, row_id: str, values: str, height: int, width: int, size: int = 2, central: int = 4, distance: int = 2) -> DataFrame:
    """(row_id, noise, brightness, uniformity) of images given as arrays by row: the mean deviation of five regions (the centre and four on the diagonals), mean and deviation of the central one.

    Regions are ``size`` wide around points ``distance`` from the centre, the central one is ``central``
    wide; all are cut at the image's edge, and such as lie outside are left out.
    """
    cx, cy = width // 2, height // 2

    def places(x: int, y: int, half: int) -> list[int]:
        return [r * width + c + 1 for r in range(max(0, y - half), min(height, y + half)) for c in range(max(0, x - half), min(width, x + half))]

    spots = [places(x, y, size // 2) for x, y in ((cx, cy), (cx - distance, cy - distance), (cx + distance, cy - distance), (cx - distance, cy + distance), (cx + distance, cy + distance))]
    middle = places(cx, cy, central // 2)
    numbered = rows.select(row_id, F.posexplode(values).alias("_at", "_v"))
    value = lambda own: F.when((F.col("_at") + 1).isin(own), F.col("_v"))
    used = [s for s in spots if s]
    one = numbered.where((F.col("_at") + 1).isin(sorted({p for s in [*used, middle] for p in s}))).groupBy(row_id).agg(*[F.stddev_pop(value(s)).alias(f"_s{i}") for i, s in enumerate(used)], F.avg(value(middle)).alias("brightness"), F.stddev_pop(value(middle)).alias("uniformity"))
    return one.select(row_id, (sum((F.col(f"_s{i}") for i in range(len(used))), F.lit(0.0)) / max(1, len(used))).alias("noise"), "brightness", "uniformity")


def preservation_report(pairs: DataFrame, by: str) -> DataFrame:
    """(by, n, range_kept_pct, values_kept_pct, psnr, mse) of pairs (a, b: arrays of values, psnr, mse), by format.

    Range is kept if the copy's range is 0.95 to 1.05 of the original's; values are if no value differs by
    1 or more once the least values are laid on each other. Means leave infinite PSNR (equal images) out.
    """
    span = lambda c: F.array_max(c) - F.array_min(c)
    ratio = span("b") / F.nullif(span("a"), F.lit(0.0))
    shifted = F.zip_with("a", "b", lambda x, y: F.abs((x - F.col("_la")) - (y - F.col("_lb"))))
    rows = pairs.withColumns({"_la": F.array_min("a"), "_lb": F.array_min("b")}).select(by, F.coalesce(ratio.between(0.95, 1.05), span("b") == 0).alias("_range"), (F.array_max(shifted) < 1).alias("_values"), F.when(F.col("psnr") < float("inf"), F.col("psnr")).alias("_psnr"), "mse")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(100 * F.count_if("_range") / F.count("*"), 6).alias("range_kept_pct"), F.round(100 * F.count_if("_values") / F.count("*"), 6).alias("values_kept_pct"), F.round(F.avg("_psnr"), 6).alias("psnr"), F.round(F.avg("mse"), 6).alias("mse"))


def research_cohorts(patients: DataFrame, least: int = 2) -> DataFrame:
    """(cohort, size) of patients (group, risk, imaging): named group_risk_imaging, of at least so many; a null part is unknown."""
    part = lambda c: F.coalesce(F.lower(F.col(c).cast("string")), F.lit("unknown"))
    return patients.groupBy(F.concat_ws("_", part("group"), part("risk"), part("imaging")).alias("cohort")).agg(F.count("*").alias("size")).where(F.col("size") >= least)


def baseline_cohorts(visits: DataFrame, key: str = "pid") -> DataFrame:
    """(key, cohort) by the mmse of a patient's first visit with one (months, then vid): from 27 normal, from 21 mild, else impaired."""
    first = visits.where("mmse is not null").groupBy(key).agg(F.min_by("mmse", F.struct("months", "vid")).alias("m"))
    return first.select(key, F.when(F.col("m") >= 27, "normal").when(F.col("m") >= 21, "mild").otherwise("impaired").alias("cohort"))


def precedence(events: DataFrame, rules: list[tuple[str, str, float]], key: str = "ptid") -> DataFrame:
    """(key, cause_id, effect_id, rule, weight, lag): for each effect the latest earlier event of each rule's cause kind; rules are (cause kind, effect kind, weight).

    events: key, id, kind, months. Of causes at one time the greatest id counts. One window a rule over the
    key's events of its two kinds; an effect without an earlier cause gives none.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy("months").rangeBetween(Window.unboundedPreceding, -1)
    parts = []
    for cause, effect, weight in rules:
        rows = events.where(F.col("kind").isin(cause, effect))
        last = F.max(F.when(F.col("kind") == cause, F.struct("months", "id"))).over(before)
        hit = rows.withColumn("_c", last).where((F.col("kind") == effect) & F.col("_c").isNotNull())
        parts.append(hit.select(key, F.col("_c.id").alias("cause_id"), F.col("id").alias("effect_id"), F.lit(f"{cause}->{effect}").alias("rule"), F.lit(float(weight)).alias("weight"), (F.col("months") - F.col("_c.months")).alias("lag")))
    return reduce(DataFrame.unionByName, parts)


def current_stages(diagnoses: DataFrame, findings: DataFrame, key: str = "ptid") -> DataFrame:
    """(key, stage): the severest stage by a patient's diagnoses (severity), else preclinical if a finding (significance) is abnormal; others are left out."""
    rank = {s: i for i, s in enumerate(STAGE_LADDER)}
    severe = cases([(F.col("severity") == s, F.lit(rank[stage])) for s, stage in SEVERITY_STAGES.items()])
    hints = findings.where("significance = 'abnormal'").select(key, F.lit(rank["preclinical"]).alias("r"))
    top = diagnoses.select(key, severe.alias("r")).unionByName(hints).groupBy(key).agg(F.max("r").alias("r")).where("r is not null")
    return top.select(key, F.get(F.array(*map(F.lit, STAGE_LADDER)), F.col("r")).alias("stage"))


def stage_progressions() -> list[tuple[str, str]]:
    """The ladder's edges, each stage to the next."""
    return list(zip(STAGE_LADDER, STAGE_LADDER[1:], strict=False))


def atrophy_links(images: DataFrame, findings: DataFrame, key: str = "ptid", within: int = 6) -> DataFrame:
    """(key, region, modalities, findings): a patient's imaged regions (images: key, region, modality) with the number of psychometric findings within so many months of baseline.

    findings: key, kind, months. Findings are counted by patient before the join, so images and findings
    never multiply; patients without such a finding, and images without region, give no row.
    """
    near = findings.where((F.col("kind") == "psychometric") & (F.abs("months") <= within)).groupBy(key).agg(F.count("*").alias("findings"))
    regions = images.where("region is not null").groupBy(key, "region").agg(F.array_sort(F.collect_set("modality")).alias("modalities"))
    return regions.join(near, key).select(key, "region", "modalities", "findings")
