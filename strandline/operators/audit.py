"""Audits of a graph: source ablation, density of multi-label nodes, rubric scores, quality reports with samples, guarded changes."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Sources of an ablation at most: its result has a row for each of their subsets.
MOST_SOURCES = 16
# Scores of the nine principles that no choice of sources changes.
OTHER_PRINCIPLES = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5, 0.5)
LEVELS = {"yes": 1.0, "partial": 0.5, "no": 0.0}


def _bit(source: Column, sources: list[str]) -> Column:
    """The source's bit; 0 for null, and one beyond all for a source that isn't among them."""
    out = F.when(source.isNull(), 0)
    for k, s in enumerate(sources):
        out = out.when(source == s, 1 << k)
    return out.otherwise(1 << len(sources))


def _subset_sums(values: np.ndarray, k: int) -> np.ndarray:
    """For each mask of k bits the sum over its submasks (a zeta transform, in place over the last axis)."""
    out = values.astype(np.int64).copy()
    masks = np.arange(1 << k)
    for b in range(k):
        high = masks[masks >> b & 1 == 1]
        out[..., high] += out[..., high ^ (1 << b)]
    return out


def source_ablation(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, sources: list[str], core: list[str] | None = None, partial: float = 0.5, full: float = 0.95) -> DataFrame:
    """One row for each subset of sources: what the graph would hold with these sources alone.

    nodes: codes (array of the sources that code a node), generic (coded whatever the sources), created_by
    (the source without which the node is not there, or null), in_core (counts for findability); edges:
    src_source and dst_source (without which an end is not there, or null), uri; concepts: source. A
    source outside the list is never there. Nulls in codes count for nothing.

    Columns: mask (bit k for source k), sources, node_total (with concepts, which are coded), nodes_coded,
    node_coverage, edge_total, edges_with_uri, edge_coverage, fair (mean of 13 principles, of which four
    depend on the subset: coded share of core nodes and concepts, edge coverage, and twice the share of
    ``core`` sources, all by default). An empty graph has coverage 0.

    Each table is counted once, by masks; all subsets come from those counts by sums over submasks. The
    driver holds at most (sources + 2) * 2 ** sources counts.
    """
    k, core = len(sources), core or sources
    if k > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark, size = nodes.sparkSession, 1 << k
    has = reduce(lambda a, b: a + b, [F.when(F.array_contains(F.coalesce("codes", F.array().cast("array<string>")), s), 1 << i).otherwise(0) for i, s in enumerate(sources)], F.lit(0))
    n = nodes.groupBy(_bit(F.col("created_by"), sources).alias("by"), F.when(F.coalesce("generic", F.lit(False)), -1).otherwise(has).alias("codes"), F.coalesce("in_core", F.lit(False)).alias("core")).agg(F.count("*").alias("n")).collect()
    e = edges.groupBy(_bit(F.col("src_source"), sources).bitwiseOR(_bit(F.col("dst_source"), sources)).alias("need")).agg(F.count("*").alias("n"), F.count("uri").alias("u")).collect()
    c = {r.source: r.n for r in concepts.where(F.col("source").isin(sources)).groupBy("source").agg(F.count("*").alias("n")).collect()}

    masks = np.arange(size)
    holds = [masks >> b & 1 == 1 for b in range(k)]
    rest = size - 1 - masks
    totals, uncoded = np.zeros((2, size), np.int64), np.zeros((2, size), np.int64)  # all nodes, core nodes
    for by in {r.by for r in n if r.by < size}:
        there = masks & by == by
        bare = np.zeros((2, size), np.int64)
        for r in (r for r in n if r.by == by):
            for i in range(1 + r.core):
                totals[i] += r.n * there
                if r.codes >= 0:
                    bare[i, r.codes] += r.n
        # a node without a code in the subset has all of its codes in the rest
        uncoded += _subset_sums(bare, k)[:, rest] * there
    need = np.zeros((2, size), np.int64)
    for r in (r for r in e if r.need < size):
        need[:, r.need] += (r.n, r.u)
    edge_total, with_uri = _subset_sums(need, k)
    own = sum((c.get(s, 0) * holds[b] for b, s in enumerate(sources)), np.zeros(size, np.int64))
    share = lambda a, b: np.divide(a, b, out=np.zeros(size), where=b > 0)
    level = lambda v: np.where(v >= full, 1.0, np.where(v >= partial, 0.5, 0.0))
    node_total, coded = totals[0] + own, totals[0] - uncoded[0] + own
    edge_share, five = share(with_uri, edge_total), sum((holds[sources.index(s)] for s in core if s in sources), np.zeros(size)) / len(core)
    scores = level(share(totals[1] - uncoded[1] + own, totals[1] + own)) + level(edge_share) + 2 * level(five)
    fair = (scores + sum(OTHER_PRINCIPLES)) / (4 + len(OTHER_PRINCIPLES))
    rows = [
        (int(m), [s for b, s in enumerate(sources) if m >> b & 1], int(node_total[m]), int(coded[m]), float(round(v, 4)), int(edge_total[m]), int(with_uri[m]), float(round(w, 4)), float(round(f, 4)))
        for m, v, w, f in zip(masks, share(coded, node_total), edge_share, fair, strict=True)
    ]
    return spark.createDataFrame(rows, "mask int, sources array<string>, node_total long, nodes_coded long, node_coverage double, edge_total long, edges_with_uri long, edge_coverage double, fair double")


def _any(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns], F.lit(False))


def graph_density(nodes: DataFrame, edges: DataFrame, node_uris: list[str], edge_uris: list[str], concept_label: str | None = None) -> DataFrame:
    """(scope, name, total, with_uri, share): nodes by label and edges by type, and once over all (name null).

    nodes has labels (array of strings): a node counts under each of its labels, once for a label that is
    there twice, and once overall; without labels (null, empty) only overall. It has a uri if any of the
    node_uris columns is filled or it is a concept: by label, where that is concept_label; overall, where
    its labels hold that. edges has type. The share of nothing is 0. One shuffle of counts for each table.
    """
    labels = F.array_distinct(F.array_compact(F.coalesce("labels", F.array().cast("array<string>"))))
    entry = lambda name, ok: F.struct(name.cast("string").alias("name"), ok.alias("ok"))
    filled = _any(node_uris)
    known = lambda label: F.lit(False) if concept_label is None else label == concept_label
    each = F.concat(F.transform(labels, lambda label: entry(label, F.col("_ok") | known(label))), F.array(entry(F.lit(None), F.col("_ok") | F.exists(labels, known))))
    of_nodes = nodes.withColumn("_ok", filled).select(F.lit("node").alias("scope"), F.explode(each).alias("e"))
    pair = F.array(entry(F.col("type"), F.col("_ok")), entry(F.lit(None), F.col("_ok")))
    of_edges = edges.where("type is not null").withColumn("_ok", _any(edge_uris)).select(F.lit("edge").alias("scope"), F.explode(pair).alias("e"))
    none = F.lit(0).cast("long")
    empty = nodes.sparkSession.createDataFrame([("node",), ("edge",)], "scope string").select("scope", F.lit(None).cast("string").alias("name"), none.alias("total"), none.alias("with_uri"))
    counted = of_nodes.unionByName(of_edges).groupBy("scope", "e.name").agg(F.count("*").alias("total"), F.count_if("e.ok").alias("with_uri"))
    both = counted.unionByName(empty).groupBy("scope", "name").agg(F.sum("total").alias("total"), F.sum("with_uri").alias("with_uri"))
    return both.withColumn("share", F.round(F.coalesce(F.col("with_uri") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6))


class Principle(NamedTuple):
    """A rule of a rubric: an aggregate over a table, or (without a table) a level found by hand."""

    id: str
    table: str | None
    rule: str
    partial: float = 0.5
    full: float = 0.95


def rubric_levels(tables: dict[str, DataFrame], rubric: list[Principle]) -> DataFrame:
    """(id, dimension, measured, level, score) of each principle; dimension is the id's first letter.

    All principles of a table are compiled into one aggregate over it. A measured value reaches yes from
    ``full``, partial from ``partial`` on, else no; null (as try_divide gives without rows) and not-a-number are no. By hand: the
    rule is the level itself (yes, partial or no in any case; anything else is no), measured is null. A
    principle of a table that isn't given is no, with measured null.
    """
    spark = next(iter(tables.values())).sparkSession
    value = F.col("measured")
    parts = []
    for name in dict.fromkeys(p.table for p in rubric):
        own = [p for p in rubric if p.table == name]
        if name in tables:
            one = tables[name].agg(*[F.expr(p.rule).cast("double").alias(f"m{i}") for i, p in enumerate(own)])
            entry = [F.struct(F.lit(p.id).alias("id"), F.col(f"m{i}").alias("measured"), F.lit(float(p.partial)).alias("partial"), F.lit(float(p.full)).alias("full")) for i, p in enumerate(own)]
            rows = one.select(F.explode(F.array(*entry)).alias("e")).select("e.*")
            level = F.when(F.isnan(value), "no").when(value >= F.col("full"), "yes").when(value >= F.col("partial"), "partial").otherwise("no")
            parts.append(rows.select("id", F.round(value, 6).alias("measured"), level.alias("level")))
        else:
            known = [(p.id, p.rule.lower() if name is None and p.rule.lower() in LEVELS else "no") for p in own]
            parts.append(spark.createDataFrame(known, "id string, level string").select("id", F.lit(None).cast("double").alias("measured"), "level"))
    score = F.when(F.col("level") == "yes", 1.0).when(F.col("level") == "partial", 0.5).otherwise(0.0)
    return reduce(DataFrame.unionByName, parts).select("id", F.upper(F.substring("id", 1, 1)).alias("dimension"), "measured", "level", score.alias("score"))


def rubric_score(levels: DataFrame) -> DataFrame:
    """(dimension, principles, score): mean score by dimension and over all."""
    rows = levels.select("dimension", "score").unionByName(levels.select(F.lit("all").alias("dimension"), "score"))
    return rows.groupBy("dimension").agg(F.count("*").alias("principles"), F.round(F.avg("score"), 6).alias("score"))


class Check(NamedTuple):
    """An issue of a table: rows for which the condition holds."""

    issue: str
    table: str
    condition: str
    key: str


def quality_report(tables: dict[str, DataFrame], checks: list[Check], samples: int = 20) -> DataFrame:
    """(issue, n, samples): how many rows have an issue, and the keys of those ``samples`` of them whose key hash is least, sorted.

    Conditions are SQL over the table's columns (null: no issue); flags such as orphan come from joins
    before. Each table is read once: its counts are observed in the job that finds the samples, which
    every task cuts to that many rows an issue before anything is shuffled. Rows of one key count each, a
    key is sampled once. Issues without rows have n 0 and no samples. Only the report passes the driver.
    """
    spark = next(iter(tables.values())).sparkSession
    out = []
    for name, rows in tables.items():
        own = [c for c in checks if c.table == name]
        if not own:
            continue
        seen = Observation()
        counted = rows.observe(seen, *[F.count_if(F.expr(c.condition)).alias(c.issue) for c in own])
        hit = F.array_compact(F.array(*[F.when(F.expr(c.condition), F.struct(F.lit(c.issue).alias("issue"), F.col(c.key).cast("string").alias("key"))) for c in own]))
        flagged = counted.select(F.explode(hit).alias("e")).select("e.issue", "e.key", F.xxhash64("e.key").alias("h"))
        # rank, not row_number, so that repeats of a key don't take a place; the cut comes before the shuffle
        rank = F.dense_rank().over(Window.partitionBy("issue").orderBy("h", "key"))
        best = flagged.withColumn("k", rank).where(F.col("k") <= samples).select("issue", "key").distinct().collect()
        out += [(c.issue, seen.get[c.issue], sorted(r.key for r in best if r.issue == c.issue and r.key is not None)) for c in own]
    return spark.createDataFrame(out, "issue string, n long, samples array<string>")


class Step(NamedTuple):
    """A guarded change of one table: drop the rows for which the condition holds, or clear a column in them; between least and most rows are expected."""

    name: str
    table: str
    condition: str
    least: int
    most: int
    clear: str | None = None


class GuardError(RuntimeError):
    pass


def current_version(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest published version."""
    version = spark.read.parquet(f"{folder}/published").orderBy(F.desc("number")).first()
    return {name: spark.read.parquet(f"{folder}/{version.version}/{name}") for name in version.tables}


def publish(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the tables as a new version, then make it the current one; a failure before leaves the old one current."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{version}/{name}")
    try:
        last = spark.read.parquet(f"{folder}/published").agg(F.max("number")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = -1
    spark.createDataFrame([(last + 1, version, sorted(tables))], "number long, version string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{folder}/published")


def roll_back(spark: SparkSession, folder: str, steps: list[Step], dry_run: bool = False) -> DataFrame:
    """Undo steps on the current version of folder's tables, all or none; returns (step, affected, kept).

    Steps are counted and applied in order, each on what the earlier ones left. A count outside a step's
    bounds raises GuardError and nothing is published: the old version stays current. With dry_run nothing
    is changed. Null conditions don't hold. Other rows, repeated ones too, stay as they are.
    """
    tables = current_version(spark, folder)
    report = []
    for step in steps:
        rows, hit = tables[step.table], F.coalesce(F.expr(step.condition), F.lit(False))
        seen = rows.agg(F.count_if(hit).alias("n"), F.count("*").alias("all")).first()
        if not step.least <= seen.n <= step.most:
            raise GuardError(f"{step.name}: {seen.n} rows, expected {step.least} to {step.most}")
        if step.clear is None:
            tables[step.table] = rows.where(~hit)
        else:
            kind = rows.schema[step.clear].dataType
            tables[step.table] = rows.withColumn(step.clear, F.when(~hit, F.col(step.clear)).otherwise(F.lit(None).cast(kind)))
        report.append((step.name, seen.n, seen.all - (seen.n if step.clear is None else 0)))
    if not dry_run:
        publish(tables, folder)
    return spark.createDataFrame(report, "step string, affected long, kept long")
