"""Feature matrices, edge consensus and effect estimates from sums that Spark gathers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.relational import quantiles

#: Rows among which the placebo test permutes treatments, about.
CELL_ROWS = 5000


def impute_and_scale(rows: DataFrame, key: str, columns: list[str], most_missing: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """key and the columns with at most that share missing: median for null, then z-scores by sample deviation (0 where it is 0), but for keep."""
    stats = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns]).first()
    used = [c for c in columns if stats["n"] and stats[f"n_{c}"] >= (1 - most_missing) * stats["n"]]
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in used]).unpivot([], used, "_column", "_value")
    medians = {r["_column"]: r["median"] for r in quantiles(long, "_column", "_value", {"median": 0.5}).collect()}  # a row a column
    full = rows.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))).alias(c) for c in used])
    spread = full.agg(*[F.avg(c).alias(f"m_{c}") for c in used], *[F.stddev_samp(c).alias(f"s_{c}") for c in used]).first()
    scaled = lambda c: F.col(c) if c in keep else (F.col(c) - spread[f"m_{c}"]) / spread[f"s_{c}"] if spread[f"s_{c}"] else F.lit(0.0)
    return full.select(key, *[scaled(c).alias(c) for c in used])


def correlation_array(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """(matrix, n) by one aggregate; the result is columns squared, whatever the rows."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    got = rows.agg(F.count("*"), *[F.corr(columns[i], columns[j]) for i, j in pairs]).first()
    m = np.eye(len(columns))
    for (i, j), r in zip(pairs, got[1:], strict=True):
        m[i, j] = m[j, i] = r if r is not None else 0.0
    return m, got[0]


def partial_correlations(rows: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """(a, b, given, r, p, independent): order 0 (given null) and order 1 partial correlations with Fisher's z test."""
    from math import erfc, log, sqrt

    m, n = correlation_array(rows, columns)
    out = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            for k in [None, *(k for k in range(len(columns)) if k not in (i, j))]:
                r = m[i, j] if k is None else (m[i, j] - m[i, k] * m[j, k]) / sqrt(max(1e-12, (1 - m[i, k] ** 2) * (1 - m[j, k] ** 2)))
                r = min(max(float(r), -0.999999), 0.999999)
                z = 0.5 * log((1 + r) / (1 - r)) * sqrt(max(1, n - 3 - (k is not None)))
                p = erfc(abs(z) / sqrt(2))
                out.append((a, columns[j], None if k is None else columns[k], round(r, 6), round(p, 6), p > alpha))
    return rows.sparkSession.createDataFrame(out, "a string, b string, given string, r double, p double, independent boolean")


def consensus(edges: DataFrame, least: int = 2) -> DataFrame:
    """(source, target, directed, algorithms, confidence): pairs found by that many algorithms.

    A pair is directed if any of its edges is; then it goes from the source that most of its edges,
    undirected ones too, name (of equally many the first by name). Else it is the sorted pair.
    """
    total = edges.agg(F.count_distinct("algorithm").alias("total"))
    pair = F.array_sort(F.array("source", "target"))
    found = edges.withColumn("x", pair[0]).withColumn("y", pair[1]).groupBy("x", "y").agg(F.array_sort(F.collect_set("algorithm")).alias("algorithms"), F.count_if(F.col("source") == F.col("x")).alias("fx"), F.count_if(F.col("source") == F.col("y")).alias("fy"), (F.count_if(F.col("direction") == "directed") > 0).alias("any_directed"))
    turned = F.col("any_directed") & (F.col("fy") > F.col("fx"))
    rows = found.where(F.size("algorithms") >= least).crossJoin(F.broadcast(total))
    return rows.select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("source"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("target"), F.col("any_directed").alias("directed"), "algorithms", F.round(F.size("algorithms") / F.col("total"), 6).alias("confidence"))


def edge_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(precision, recall, f1, shd) of directed pairs."""
    from strandline.operators.relational import set_difference

    s = set_difference(found, truth, ["source", "target"]).agg(*[F.count_if(F.col("status") == k).alias(k.lower()) for k in ("TP", "FP", "FN")])
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return s.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), (F.col("fp") + F.col("fn")).alias("shd"))


def matrix_edges(rows: DataFrame, names: list[str], row: str, marks: str) -> DataFrame:
    """(source, target, kind) of an adjacency matrix given as one row of marks a variable: 1 -->, 2 ---, 3 o->."""
    label = F.array(*map(F.lit, names))
    cells = rows.select(F.get(label, F.col(row)).alias("source"), F.posexplode(marks).alias("k", "mark"))
    return cells.select("source", F.get(label, F.col("k")).alias("target"), F.when(F.col("mark") == 1, "-->").when(F.col("mark") == 2, "---").when(F.col("mark") == 3, "o->").alias("kind")).where("kind is not null")


def effect(rows: DataFrame, treatment: str, outcome: str, adjust: list[str], by: str | None = None) -> DataFrame:
    """(by, n, effect): least-squares coefficient of treatment for outcome given the adjustment columns.

    Each group's normal equations are sums, solved where they arrive: one small row a group.
    """
    x = [F.lit(1.0), F.col(treatment).cast("double"), *[F.col(c).cast("double") for c in adjust]]
    y = F.col(outcome).cast("double")
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * y).alias(f"y{i}") for i in range(k)]
    grouped = rows.groupBy(by if by else F.lit("all").alias("by")).agg(F.count("*").alias("n"), *sums)
    group = by or "by"

    def solve(frames):
        for pdf in frames:
            out = []
            for _, r in pdf.iterrows():
                a = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                out.append(float(np.linalg.lstsq(a, np.array([r[f"y{i}"] for i in range(k)]), rcond=None)[0][1]))
            yield pdf[[group, "n"]].assign(effect=np.round(out, 6))

    kind = grouped.schema[group].dataType.simpleString()
    return grouped.mapInPandas(solve, f"{group} {kind}, n long, effect double")


def backdoor_set(edges: DataFrame, treatment: str, outcome: str, columns: list[str]) -> list[str]:
    """The columns to adjust for: the treatment's parents in the edge table (source, target), sorted.

    Parents block every back-door path if they come before the treatment: a parent that is also one of
    its descendants, the outcome as a parent, or a parent that isn't among the columns is refused with a
    ValueError, as the effect could not be told from the edges. Edges with a null end and self loops are
    ignored. Only edges between variables pass the driver; a graph of variables has as many as a rule table.
    """
    pairs = {(r.source, r.target) for r in edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct().collect()}
    parents = sorted(a for a, b in pairs if b == treatment)
    below, new = set(), {treatment}
    while new := {b for a, b in pairs if a in new} - below:
        below |= new
    if wrong := [p for p in parents if p in below or p == outcome]:
        raise ValueError(f"{wrong} cause the treatment {treatment} and follow from it")
    if hidden := [p for p in parents if p not in columns]:
        raise ValueError(f"{hidden} cause the treatment {treatment} and aren't observed")
    return parents


def backdoor_effect(rows: DataFrame, edges: DataFrame, treatment: str, outcome: str, by: str | None = None) -> DataFrame:
    """(by, n, effect) of treatment on outcome, adjusted for the treatment's parents in the edge table; see backdoor_set and effect."""
    return effect(rows, treatment, outcome, backdoor_set(edges, treatment, outcome, rows.columns), by)


def edge_scores_either_way(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(precision, recall, f1, shd, n_found, n_true): found edges (source, target, direction) against true directed pairs.

    An undirected edge stands for both directed pairs. Repeats count once; edges with a null end are left out; shd is the
    number of pairs in one set only; scores without a basis are 0.
    """
    from strandline.operators.relational import set_difference

    both = found.where("direction = 'undirected'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    pairs, known = (df.where("source is not null and target is not null").select("source", "target").distinct() for df in (found.select("source", "target").unionByName(both), truth))
    s = set_difference(pairs, known, ["source", "target"]).agg(*[F.count_if(F.col("status") == k).alias(k.lower()) for k in ("TP", "FP", "FN")])
    n, m = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    rate = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    return s.select(rate(F.col("tp"), n).alias("precision"), rate(F.col("tp"), m).alias("recall"), rate(2 * F.col("tp"), n + m).alias("f1"), (F.col("fp") + F.col("fn")).alias("shd"), n.alias("n_found"), m.alias("n_true"))


def refuters(rows: DataFrame, key: str, treatment: str, outcome: str, adjust: list[str], rounds: int = 50, seed: int = 7) -> DataFrame:
    """(test, mean_effect, share, passed): placebo (treatment of another row, by random), 80 % subset, and a random common cause.

    Rows are dealt once over random cells of some CELL_ROWS by a hash of the key; in each round treatments trade places
    within their cell, so no round is shuffled or joined. Rows of a cell are sorted by a hash and its generator starts
    from seed and cell, the other draws are hashes of row and round: results repeat under any partitioning.
    """
    base = effect(rows, treatment, outcome, adjust).select(F.col("effect").alias("base"))
    cells = max(1, rows.count() // CELL_ROWS)
    dealt = rows.select(F.pmod(F.xxhash64(key, F.lit(seed + 2)), F.lit(cells)).alias("_cell"), F.xxhash64(key, F.lit(seed)).alias("_h"), F.col(treatment).cast("double").alias("_t"), *[F.col(c).cast("double").alias(c) for c in (outcome, *adjust)])

    def trade(cell: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "_t", outcome, *adjust])
        draws = np.random.default_rng([seed, int(cell[0])])
        return pd.concat([pdf.assign(round=i, _t=draws.permutation(pdf["_t"].to_numpy())) for i in range(1, rounds + 1)])[["round", "_t", outcome, *adjust]]

    traded = dealt.groupBy("_cell").applyInPandas(trade, ", ".join(["round int", "_t double", *[f"`{c}` double" for c in (outcome, *adjust)]]))
    placebo = effect(traded, "_t", outcome, adjust, "round")
    many = rows.select(key, treatment, outcome, *adjust, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    draw = F.xxhash64(F.col(key), F.col("round"), F.lit(seed))
    subset = effect(many.where(F.pmod(draw, F.lit(10)) < 8), treatment, outcome, adjust, "round")
    cause = effect(many.withColumn("_u", F.pmod(draw, F.lit(1_000_003)) / 1_000_003), treatment, outcome, [*adjust, "_u"], "round")
    parts = []
    for name, df, limit in (("placebo", placebo, 0.5), ("subset", subset, 0.5), ("common_cause", cause, 0.3)):
        m = df.agg(F.avg("effect").alias("mean_effect")).crossJoin(base)
        share = F.abs(F.col("mean_effect") if name == "placebo" else F.col("mean_effect") - F.col("base")) / F.abs("base")
        parts.append(m.select(F.lit(name).alias("test"), F.round("mean_effect", 6).alias("mean_effect"), F.round(share, 6).alias("share"), (share <= limit).alias("passed")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
