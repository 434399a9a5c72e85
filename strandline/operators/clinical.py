"""Derived clinical entities and the event model: profiles, stages, cohorts, survival, event chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The three sets of A/T/N thresholds (amyloid low, tau high, neurodegeneration high).
ATN_PRESETS = {"csf": (1100.0, 27.0, 400.0), "classic": (600.0, 80.0, 400.0), "assay": (192.0, 23.0, 93.0)}
ATN_TEXTS = {
    "A-T-N-": "Normal biomarkers", "A+T-N-": "Alzheimer's pathologic change", "A+T+N-": "Alzheimer's disease", "A+T+N+": "Alzheimer's disease", "A+T-N+": "Alzheimer's and suspected non-Alzheimer's change",
    "A-T+N-": "Non-Alzheimer's pathologic change", "A-T-N+": "Non-Alzheimer's pathologic change", "A-T+N+": "Non-Alzheimer's pathologic change",
}
STAGE_RANK = {"CN": 0, "SMC": 1, "EMCI": 2, "MCI": 3, "LMCI": 4, "AD": 5}
STAGE_MONTHS = (("CN", "MCI", 36), ("MCI", "LMCI", 18), ("LMCI", "AD", 24))


def rank_of(stage: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STAGE_RANK.items() for x in kv]), stage)


def atn_profile(facts: DataFrame, by: str, analytes: tuple[str, str, str], thresholds: tuple[float, float, float], unknown: bool = False) -> DataFrame:
    """(by, profile, n_positive): A+ below its threshold, T+ and N+ above; a missing analyte is - or, with unknown, ?."""
    low, tau, neuro = thresholds
    tests = [(F.col("value") < low), (F.col("value") > tau), (F.col("value") > neuro)]
    flags = [F.bool_or(F.when(F.col("analyte") == a, hit)).alias(k) for k, a, hit in zip("atn", analytes, tests)]
    sign = lambda k: F.concat(F.lit(k.upper()), F.when(F.col(k), "+").when(F.col(k).isNull() & F.lit(unknown), "?").otherwise("-"))
    rows = facts.groupBy(by).agg(*flags)
    return rows.select(by, F.concat(*[sign(k) for k in "atn"]).alias("profile"), sum(F.coalesce(F.col(k), F.lit(False)).cast("int") for k in "atn").alias("n_positive"))


def biomarker_profile(facts: DataFrame, by: str) -> DataFrame:
    """(by, n, n_abnormal, markers): the key's mean by analyte as a map, from rows given (baseline, usually)."""
    means = facts.groupBy(by, "analyte").agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.sum("abnormal").alias("bad"))
    return means.groupBy(by).agg(F.sum("n").alias("n"), F.sum("bad").alias("n_abnormal"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("analyte", F.round("mean", 4))))).alias("markers"))


def cohort_of(visits: DataFrame) -> DataFrame:
    """(pid, cohort): the most advanced diagnosis of a patient."""
    return visits.groupBy("pid").agg(F.max_by("dx", rank_of(F.col("dx"))).alias("cohort"))


def progression(visits: DataFrame) -> DataFrame:
    """(pid, vid, from_stage, to_stage, speed): steps up in stage rank between visits in order; gradual if by one stage."""
    w = Window.partitionBy("pid").orderBy("months", "vid")
    rows = visits.select("pid", "vid", F.lag("dx").over(w).alias("from_stage"), F.col("dx").alias("to_stage"))
    up = rank_of(F.col("to_stage")) - rank_of(F.col("from_stage"))
    return rows.where(up > 0).withColumn("speed", F.when(up == 1, "gradual").otherwise("rapid"))


def kaplan_meier(subjects: DataFrame, group: str, time: str, event: str, horizon: int = 120) -> DataFrame:
    """(group, time, at_risk, events, survival) at each event time; no event within horizon months is censored there.

    One row for each group and time after the first aggregate, so the windows over a group are small.
    """
    t = F.least(F.coalesce(time, F.lit(horizon)), F.lit(horizon)).alias("time")
    counted = subjects.groupBy(group, t).agg(F.sum(F.col(event).cast("int")).alias("events"), F.count("*").alias("n"))
    later = Window.partitionBy(group).orderBy("time").rowsBetween(0, Window.unboundedFollowing)
    until = Window.partitionBy(group).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.withColumn("at_risk", F.sum("n").over(later)).withColumn("p", 1 - F.col("events") / F.col("at_risk"))
    gone = F.max(F.col("p") <= 0).over(until)
    survival = F.when(gone, 0.0).otherwise(F.exp(F.sum(F.log(F.when(F.col("p") > 0, F.col("p")).otherwise(1.0))).over(until)))
    return rows.withColumn("survival", F.round(survival, 6)).where("events > 0").select(group, "time", "at_risk", "events", "survival")


def state_changes(rows: DataFrame, key: str, order: list[str], value: str, kind: str) -> DataFrame:
    """(key, kind, months, from_state, to_state, duration) events of changes of value; months are set from the visit."""
    w = Window.partitionBy(key).orderBy(*order)
    out = rows.withColumn("from_state", F.lag(value).over(w)).withColumn("before", F.lag(order[0]).over(w)).where(F.col("from_state") != F.col(value))
    return out.select(key, F.lit(kind).alias("kind"), F.col(order[0]).alias("months"), "from_state", F.col(value).alias("to_state"), (F.col(order[0]) - F.col("before")).alias("duration"))


def chains(events: DataFrame, key: str, order: list[str], name: str, time: str) -> DataFrame:
    """(key, n, start, stop, sequence): all events of a key in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, name))), lambda s: s[name])
    return events.groupBy(key).agg(F.count("*").alias("n"), F.min(time).alias("start"), F.max(time).alias("stop"), F.array_join(listed, ">").alias("sequence"))


def trigrams(events: DataFrame, key: str, order: list[str], name: str, least: int = 5) -> DataFrame:
    """(sequence, n, pct) of three events in a row, of at least that frequency."""
    w = Window.partitionBy(key).orderBy(*order)
    three = events.select(F.col(name).alias("a"), F.lead(name, 1).over(w).alias("b"), F.lead(name, 2).over(w).alias("c")).where("c is not null")
    counted = three.groupBy(F.concat_ws(">", "a", "b", "c").alias("sequence")).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)).where(F.col("n") >= least)


def markov(transitions: DataFrame) -> DataFrame:
    """transitions (from_state, to_state, n) with probability, n over all from the state."""
    return transitions.withColumn("probability", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_state")), 6))


def group_by_keyword(columns: list[str], rules: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """Columns of a wide row by the first group one of whose words the name holds; the rest under other."""
    out: dict[str, list[str]] = {}
    for c in columns:
        group = next((g for g, words in rules.items() if any(w in c.lower() for w in words)), "other")
        out.setdefault(group, []).append(c)
    return out


def grouped_maps(rows: DataFrame, key: str, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """key with one map column for each group of columns, without null values."""
    groups = group_by_keyword([c for c in rows.columns if c != key], rules)
    maps = [F.map_filter(F.create_map(*[x for c in cs for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()).alias(g) for g, cs in groups.items()]
    return rows.select(key, *maps)


# Words of a column's name by group, in the order in which they are tried; the rest is clinical. Regions by network.
ATTRIBUTE_WORDS = {
    "demographic": ("age", "gender", "sex", "education", "race", "ethnic", "marital"), "family_history": ("family", "relative", "parent", "sibling", "mother", "father"),
    "clinical": ("medical", "history", "diagnosis", "medication", "surgery"), "assessment": ("mmse", "moca", "cdr", "adas", "faq", "ravlt", "score"),
}
REGION_NETWORKS = {"hippocampus": "hippocampal", "temporal_lobe": "hippocampal", "cortex": "default_mode", "parietal_lobe": "default_mode"}
MEMBER_RELATIONS = (("PAR", "parent"), ("SIB", "sibling"), ("CHILD", "child"))


def patient_records(rows: DataFrame, order: list[str], patient: str = "PTID", other: str = "RID") -> DataFrame:
    """(patient, demographic, family_history, clinical, assessment): one row a patient, maps of its columns by ATTRIBUTE_WORDS.

    The patient is the patient column, else the other one; rows with neither are left out. Of several rows a
    column's last value by order that is not null counts. Columns are texts; ids are in no map.
    """
    given = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    columns = [c for c in rows.columns if c not in (patient, other)]
    groups = group_by_keyword(columns, ATTRIBUTE_WORDS)
    groups["clinical"] = [*groups.get("clinical", []), *groups.pop("other", [])]
    last = [F.max_by(F.trim(F.col(c).cast("string")), F.when(F.col(c).isNotNull(), F.struct(*order, c))).alias(f"_{i}") for i, c in enumerate(columns)]
    one = rows.withColumn("_patient", F.coalesce(given(patient), given(other))).where("_patient is not null").groupBy("_patient").agg(F.count("*").alias("_n"), *last)
    place = {c: f"_{i}" for i, c in enumerate(columns)}
    of = lambda cs: F.map_filter(F.create_map(*[x for c in cs for x in (F.lit(c), F.col(place[c]))]), lambda _, v: v.isNotNull()) if cs else F.create_map().cast("map<string,string>")
    return one.select(F.col("_patient").alias("patient"), *[of(groups.get(g, [])).alias(g) for g in ATTRIBUTE_WORDS])


def members_of_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(member_id, patient, relation, has_dementia, onset, gender, table) of family-history tables, one member a row.

    Tables whose name holds FAMHX, FAMILY or RELATIVE count. The relation comes from the table's name, dementia
    (DEMENTIA, AD or ALZHEIMER; a number, yes or no), onset (ONSET and AGE) and gender (GENDER or SEX) from
    columns by their names, of several the last by place that says something. The id is a hash of patient,
    relation and the row's values, so that equal rows are one member. Rows without patient are left out.
    """
    parts = []
    for name, df in tables.items():
        up = name.upper()
        if not any(w in up for w in ("FAMHX", "FAMILY", "RELATIVE")):
            continue
        relation = next((r for w, r in MEMBER_RELATIONS if w in up), "unknown")
        whose = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("PTID", "SUBJID", "RID") if c in df.columns], F.lit(None).cast("string"))
        dementia, onset, gender = [], [], []
        for c, kind in df.dtypes:
            u, text = c.upper(), F.upper(F.trim(F.col(c).cast("string")))
            if any(w in u for w in ("DEMENTIA", "AD", "ALZHEIMER")):
                number = F.col(c).cast("double") != 0 if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") else F.lit(None).cast("boolean")
                dementia.append(F.coalesce(number, F.when(text.isin("YES", "Y", "1", "TRUE"), True).when(text.isin("NO", "N", "0", "FALSE"), False)))
            elif "ONSET" in u and "AGE" in u:
                onset.append(F.col(c).try_cast("double").cast("int"))
            elif "GENDER" in u or "SEX" in u:
                gender.append(F.col(c).cast("string"))
        last = lambda cs, kind: F.coalesce(*reversed(cs), F.lit(None).cast(kind)).cast(kind)
        values = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
        key = F.concat(F.lit("fm_"), F.substring(F.md5(F.concat_ws("_", whose, F.lit(relation), values)), 1, 12))
        parts.append(df.select(key.alias("member_id"), whose.alias("patient"), F.lit(relation).alias("relation"), last(dementia, "boolean").alias("has_dementia"), last(onset, "int").alias("onset"), last(gender, "string").alias("gender"), F.lit(name).alias("table")).where("patient is not null").distinct())
    return reduce(DataFrame.unionByName, parts)


def region_network(region: Column) -> Column:
    """The brain network of an anatomical region; null for regions of none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in REGION_NETWORKS.items() for x in kv]), region)


def canonical_snapshot(nodes: DataFrame, edges: DataFrame, counts: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: node_total, edge_total, labels, types, nodes_coded, edges_with_uri, their coverages, each of ``counts``, and the maps by_label and by_type.

    nodes: label, uri and the columns that conditions name; edges: type, uri; counts: name -> (nodes or edges,
    SQL condition). Each table is aggregated once by label or type, all scalars coming from these small rows.
    """
    of = {"nodes": (nodes, "label"), "edges": (edges, "type")}
    made = {}
    for kind, (rows, by) in of.items():
        own = {n: c for n, (k, c) in counts.items() if k == kind}
        grouped = rows.groupBy(by).agg(F.count("*").alias("_n"), F.count("uri").alias("_u"), *[F.count_if(F.expr(c)).alias(n) for n, c in own.items()])
        entries = F.array_sort(F.collect_list(F.when(F.col(by).isNotNull(), F.struct(F.col(by).alias("k"), F.col("_n").alias("v")))))
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        made[kind] = grouped.agg(zero("_n").alias(f"{kind[:-1]}_total"), F.count(by).alias(f"{by}s"), zero("_u").alias(f"{kind}_with_uri"), *[zero(n).alias(n) for n in own], F.map_from_entries(entries).alias(f"by_{by}"))
    one = made["nodes"].crossJoin(made["edges"])
    share = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 4)
    return one.withColumns({"node_coverage": share("nodes_with_uri", "node_total"), "edge_coverage": share("edges_with_uri", "edge_total")})
