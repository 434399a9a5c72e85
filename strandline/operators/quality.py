"""Ontology grounding, quality gates and graph metrics, search ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.clean import uri_namespace


def maps_to(rows: DataFrame, row_id: str, code: str, prefix: str, concepts: DataFrame, kind: str = "MAPS_TO") -> DataFrame:
    """(src, type, dst) edges from rows to the concept prefix + code, where it exists."""
    want = rows.where(F.col(code).isNotNull()).select(F.col(row_id).alias("src"), F.concat(F.lit(prefix), code).alias("uri"))
    return want.join(concepts.select("uri"), "uri").select("src", F.lit(kind).alias("type"), F.col("uri").alias("dst"))


def hierarchy(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """(child, parent) pairs both of which are concepts."""
    one = pairs.join(concepts.select(F.col("uri").alias("child")), "child", "left_semi")
    return one.join(concepts.select(F.col("uri").alias("parent")), "parent", "left_semi").select("child", "parent")


def fill_uris(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """edges whose null uri is the rule's for their type."""
    return edges.join(F.broadcast(rules.withColumnRenamed("uri", "_rule")), "type", "left").withColumn("uri", F.coalesce("uri", "_rule")).drop("_rule")


def value_pattern_match(rows: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """rows joined with the rules whose value pattern A|B|C holds the column's value; patterns are split, so it stays an equi join."""
    keys = rules.withColumn("_v", F.explode(F.split("pattern", r"\|")))
    return rows.join(F.broadcast(keys), F.col(column) == F.trim("_v")).drop("_v", "pattern")


def density_by(rows: DataFrame, by: str, uri: str = "uri") -> DataFrame:
    """(by, total, with_uri, share), 0 of 0 being 0."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count(uri).alias("with_uri")).withColumn("share", F.round(F.coalesce(F.col("with_uri") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6))


def duplicity(checks: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(name, total, distinct_keys, extra) of each table's key."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("total"), F.count_distinct(F.struct(*keys)).alias("distinct_keys")) for name, (df, keys) in checks.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("extra", F.col("total") - F.col("distinct_keys"))


def source_contribution(edges: DataFrame) -> DataFrame:
    """(namespace, n, pct) of edges with a uri."""
    n = edges.where("uri is not null").groupBy(uri_namespace(F.col("uri")).alias("namespace")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def gate(checks: list[tuple[str, DataFrame, float, bool]]) -> DataFrame:
    """(id, measured, passed, hard_fail): each check is a one-row frame with ``measured``, its least value and whether failing is hard."""
    parts = [df.select(F.lit(i).alias("id"), F.round(F.col("measured").cast("double"), 6).alias("measured"), (F.col("measured") >= least).alias("passed"), ((F.col("measured") < least) & F.lit(hard)).alias("hard_fail")) for i, df, least, hard in checks]
    return reduce(DataFrame.unionByName, parts)


def sources_present(concepts: DataFrame, source: str, required: list[str], bands: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """One row (measured): the share met of the demands that each required source has a concept, and that counts lie in their bands; names in any case."""
    n = {name: F.count_if(F.upper(source) == name.upper()) for name in [*required, *(bands or {})]}
    met = [n[r] > 0 for r in required] + [n[b].between(low, high) for b, (low, high) in (bands or {}).items()]
    return concepts.agg((sum((m.cast("int") for m in met), F.lit(0)) / F.lit(max(1, len(met)))).alias("measured"))


def types_covered(edges: DataFrame, least: float = 0.95, exempt: list[str] = ()) -> DataFrame:
    """One row (measured): the share of edge types, exempt ones aside, of whose edges at least that share has a uri; 1 where all are exempt, 0 without edges."""
    by = edges.groupBy("type").agg((F.count("uri") / F.count("*")).alias("share")).withColumn("out", F.upper("type").isin([e.upper() for e in exempt]))
    kept = F.count_if(~F.col("out"))
    return by.agg(F.when(F.count("*") == 0, 0.0).when(kept == 0, 1.0).otherwise(F.count_if(~F.col("out") & (F.col("share") >= least)) / kept).alias("measured"))


def concepts_reached(concepts: DataFrame, edges: DataFrame, types: list[str], exempt: list[str] = ()) -> DataFrame:
    """One row (measured): the share of concepts (id, uri) that an edge of these types leads to or whose uri is exempt; 1 without concepts."""
    hit = edges.where(F.col("type").isin(types)).select(F.col("dst").alias("id")).distinct().withColumn("_hit", F.lit(True))
    rows = concepts.select("id", "uri").join(hit, "id", "left")
    return rows.agg(F.coalesce(F.count_if(F.col("_hit").isNotNull() | F.coalesce(F.col("uri").isin(list(exempt)), F.lit(False))) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("measured"))


def fair_score(measured: DataFrame, rubric: DataFrame) -> DataFrame:
    """(dimension, score): yes 1, partial 0.5, no 0 by the rubric's thresholds; the overall mean under dimension all."""
    value = F.coalesce("measured", F.lit(0.0))
    rows = rubric.join(measured, "id", "left").select("dimension", F.when(value >= F.col("full"), 1.0).when(value >= F.col("partial"), 0.5).otherwise(0.0).alias("score"))
    return rows.unionByName(rows.withColumn("dimension", F.lit("all"))).groupBy("dimension").agg(F.round(F.avg("score"), 6).alias("score"))


def ablation(edges: DataFrame, subsets: dict[str, list[str]]) -> DataFrame:
    """(scenario, kept, share): edges whose namespace a scenario keeps, from one count by namespace; edges without uri stay."""
    buckets = edges.groupBy(F.coalesce(uri_namespace(F.col("uri")), F.lit("none")).alias("ns")).agg(F.count("*").alias("n"))
    rows = edges.sparkSession.createDataFrame(list(subsets.items()), "scenario string, sources array<string>")
    total = F.sum("n").alias("total")
    kept = F.sum(F.when((F.col("ns") == "none") | F.array_contains("sources", F.col("ns")), F.col("n")).otherwise(0)).alias("kept")
    # buckets are at most as many as namespaces
    return buckets.crossJoin(F.broadcast(rows)).groupBy("scenario").agg(kept, total).select("scenario", "kept", F.round(F.col("kept") / F.col("total"), 6).alias("share"))


def step_deltas(counts: DataFrame, order: str, *measures: str) -> DataFrame:
    """Step counts with d_<measure>, the change to the step before (the first step's to 0). One row a step."""
    w = Window.partitionBy().orderBy(order)
    return counts.select("*", *[(F.col(m) - F.coalesce(F.lag(m).over(w), F.lit(0))).alias(f"d_{m}") for m in measures])


def equivalent(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of two snapshots that differ."""
    from strandline.operators.relational import before_after

    return before_after(before, after, key, value).where("delta <> 0")


def label_audit(concepts: DataFrame, reference: DataFrame) -> DataFrame:
    """(uri, status): match, mismatch or unresolved, comparing labels in lower case."""
    rows = concepts.select("uri", F.lower("label").alias("a")).join(reference.select("uri", F.lower("label").alias("b")), "uri", "left")
    return rows.select("uri", F.when(F.col("b").isNull(), "unresolved").when(F.col("a") == F.col("b"), "match").otherwise("mismatch").alias("status"))


def quality_bands(rows: DataFrame, score: Column) -> DataFrame:
    band = F.when(score >= 0.9, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"))


def _close(word: str, slack: int):
    return lambda w: F.levenshtein(w, F.lit(word)) <= slack


def fuzzy_rank(rows: DataFrame, row_id: str, text: dict[str, float], asked: str, k: int) -> DataFrame:
    """(row_id, score) of the best k rows: each asked word scores a field's weight if the field has a word within the automatic edit distance (0 up to 2 letters, 1 up to 5, else 2)."""
    score = F.lit(0.0)
    for word in asked.lower().split():
        slack = 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2
        for field, weight in text.items():
            near = F.exists(F.split(F.lower(F.coalesce(field, F.lit(""))), r"\W+"), _close(word, slack))
            score = score + F.when(near, weight).otherwise(0.0)
    return rows.select(row_id, score.alias("score")).where("score > 0").orderBy(F.desc("score"), row_id).limit(k)


def combined_rank(parts: dict[str, tuple[DataFrame, float]], k: int) -> DataFrame:
    """(kind, id, score) of the best k over kinds, scores times their kind's weight; each part has id and score."""
    rows = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.round(F.col("score") * weight, 6).alias("score")) for kind, (df, weight) in parts.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("score"), "kind", "id").limit(k)


def facets(rows: DataFrame, *fields: str) -> DataFrame:
    """(field, value, n)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    return rows.select(each).select("x.*").groupBy("field", "value").agg(F.count("*").alias("n"))


def suggestions(terms: DataFrame, column: str, text: str, k: int = 5) -> DataFrame:
    """Distinct terms that hold the text, those that start with it first."""
    low = F.lower(column)
    return terms.select(column).distinct().where(low.contains(text.lower())).orderBy(~low.startswith(text.lower()), column).limit(k)


def step_durations(lines: DataFrame) -> DataFrame:
    """(step, runs, seconds) of log lines like ``step NAME finished in 12.3 s``."""
    rows = lines.select(F.regexp_extract("value", r"step (\w+) finished in ([\d.]+) ?s", 1).alias("step"), F.regexp_extract("value", r"finished in ([\d.]+) ?s", 1).try_cast("double").alias("s"))
    return rows.where("step <> '' and s is not null").groupBy("step").agg(F.count("*").alias("runs"), F.round(F.sum("s"), 3).alias("seconds"))
