"""Queries over array functions, feature matrices and causal analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import arrays as a
from strandline.functions.clean import lookup
from strandline.operators import causal as x
from strandline.operators import relational as r
from strandline.plans.cohort import query

_PAIR = "SELECT vec_id, list_transform(embedding, lambda v: v::double) AS e, list_transform(embedding, lambda v: v::double * 2 + (1 + vec_id % 3) * 0.01::double * v::double * v::double) AS g FROM embeddings"


def _pair(t):
    e = a.doubles(F.col("embedding"))
    return t.embeddings.select("vec_id", "label", e.alias("e")).withColumn("g", F.expr("transform(e, v -> v * 2 + (1 + vec_id % 3) * 0.01D * v * v)"))


@query("n01_psnr_mse", f"""SELECT vec_id, round(m, 9) AS mse, CASE WHEN m = 0 THEN 'inf' ELSE 'finite' END AS psnr FROM (SELECT vec_id, list_sum(list_transform(list_zip(list_transform(e, lambda v: (v - list_min(e)) / (list_max(e) - list_min(e))), list_transform(g, lambda v: (v - list_min(g)) / (list_max(g) - list_min(g)))), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(e) AS m FROM ({_PAIR}))""")
def n01(t):
    rows = _pair(t).select("vec_id", a.mse(F.col("e"), F.col("g")).alias("m"))
    return rows.select("vec_id", F.round("m", 9).alias("mse"), F.when(a.psnr(F.col("m")) == float("inf"), "inf").otherwise("finite").alias("psnr"))


@query("n02_contrast", "SELECT vec_id, round(stddev_pop(v), 6) AS contrast, round(quantile_cont(v, 0.75), 6) AS p75 FROM (SELECT vec_id, unnest(embedding)::double AS v FROM embeddings) GROUP BY 1")
def n02(t):
    e = a.doubles(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(a.deviation(e), 6).alias("contrast"), F.round(a.quantile(F.array_sort(e), 0.75), 6).alias("p75"))


@query("n03_entropy", "SELECT vec_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT vec_id, floor((v + 1) / 2 * 64) AS b, count(*) AS n FROM (SELECT vec_id, unnest(embedding)::double AS v FROM embeddings) GROUP BY ALL) GROUP BY 1")
def n03(t):
    return a.entropy(t.embeddings.select("vec_id", a.doubles(F.col("embedding")).alias("e")), "vec_id", "e", 64, -1.0, 1.0)


@query("n04_histogram_stats", """WITH v AS (SELECT vec_id, unnest(embedding)::double AS v FROM embeddings), q AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, max(v) - min(v) AS r FROM v GROUP BY 1),
    c AS (SELECT v.vec_id, v, r, avg(v) OVER (PARTITION BY v.vec_id) AS m FROM v JOIN q ON v.vec_id = q.vec_id WHERE v BETWEEN lo AND hi), k AS (SELECT vec_id, any_value(m) AS m, any_value(r) AS r, avg((v - m) ** 2) AS s2, avg((v - m) ** 3) AS s3, avg((v - m) ** 4) AS s4 FROM c GROUP BY 1)
    SELECT vec_id, round(m, 6) AS mean, round(sqrt(s2), 6) AS sd, round(s3 / s2 ** 1.5, 6) AS skewness, round(s4 / (s2 * s2) - 3, 6) AS kurtosis, round(r, 6) AS range FROM k""")  # fmt: skip
def n04(t):
    rows = a.histogram_stats(t.embeddings.select("vec_id", a.doubles(F.col("embedding")).alias("e")), "vec_id", "e")
    return rows.select("vec_id", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "skewness", "kurtosis", "range")])


@query("n05_auto_window", "SELECT vec_id, round((lo + hi) / 2, 6) AS center, round(hi - lo, 6) AS width FROM (SELECT vec_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM (SELECT vec_id, unnest(embedding)::double AS v FROM embeddings) WHERE v <> 0 GROUP BY 1)")
def n05(t):
    w = a.auto_window(a.doubles(F.col("embedding")))
    return t.embeddings.select("vec_id", w.alias("w")).select("vec_id", F.round("w.center", 6).alias("center"), F.round("w.width", 6).alias("width"))


@query("n06_roi_noise", "SELECT vec_id, round((a + b) / 2, 6) AS noise FROM (SELECT vec_id, stddev_pop(v) FILTER (WHERE k <= 8) AS a, stddev_pop(v) FILTER (WHERE k > 8 AND k <= 16) AS b FROM (SELECT vec_id, unnest(embedding)::double AS v, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) GROUP BY 1)")
def n06(t):
    return t.embeddings.select("vec_id", F.round(a.roi_noise(a.doubles(F.col("embedding")), [(1, 8), (9, 8)]), 6).alias("noise"))


@query("n07_quality_grade", "SELECT vid, CASE WHEN s >= 0.8 THEN 'A' WHEN s >= 0.6 THEN 'B' WHEN s >= 0.4 THEN 'C' ELSE 'D' END AS grade FROM (SELECT vid, 0.3 * least(mmse / 50, 1.0::double) + 0.4 * 0.9::double + 0.2 * least(mmse / 30, 1.0::double) + 0.1 * least(months / 100, 1.0::double) AS s FROM visits)")
def n07(t):
    return t.visits.select("vid", a.quality_grade(F.col("mmse"), F.lit(0.9), F.col("mmse"), F.col("months")).alias("grade"))


@query("n08_anova", "SELECT round(((q - s * s / n) / (k - 1)) / (w / (n - k)), 6) AS f, k AS groups, n::bigint AS n FROM (SELECT sum(n) AS n, count(*) AS k, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS w FROM (SELECT dx, count(mmse) AS n, avg(mmse) AS m, var_pop(mmse) AS v FROM visits GROUP BY 1))")
def n08(t):
    return a.one_way_f(t.visits, "dx", "mmse")


@query("n09_preservation", "SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1")
def n09(t):
    shifted = t.embeddings.select("vec_id", "label", a.doubles(F.col("embedding")).alias("e")).withColumn("g", F.expr("transform(e, v -> CASE WHEN vec_id % 2 = 0 THEN v + 5 ELSE v * 3 END)"))
    return shifted.where(a.preserved(F.col("e"), F.col("g"))).groupBy("label").agg(F.count("*").alias("n"))


@query("n10_sample", "SELECT vid FROM visits ORDER BY md5(concat(vid, '|', 5)), vid LIMIT 50")
def n10(t):
    return a.stable_sample(t.visits, "vid", 50, 5).select("vid")


@query("x01_feature_matrix", "SELECT p.pid, age, edu, v.mmse, f.tau, f.ptau FROM patients p LEFT JOIN (SELECT pid, round(avg(mmse), 6) AS mmse FROM visits WHERE months = 0 GROUP BY 1) v ON p.pid = v.pid LEFT JOIN (SELECT pid, round(avg(value) FILTER (WHERE analyte = 'TAU'), 6) AS tau, round(avg(value) FILTER (WHERE analyte = 'PTAU'), 6) AS ptau FROM facts WHERE months = 0 GROUP BY 1) f ON p.pid = f.pid")
def x01(t):
    mmse = t.visits.where("months = 0").groupBy("pid").agg(F.round(F.avg("mmse"), 6).alias("mmse"))
    marks = t.facts.where("months = 0").groupBy("pid").pivot("analyte", ["TAU", "PTAU"]).agg(F.round(F.avg("value"), 6))
    return t.patients.select("pid", "age", "edu").join(mmse, "pid", "left").join(marks.select("pid", F.col("TAU").alias("tau"), F.col("PTAU").alias("ptau")), "pid", "left")


@query("x02_impute_scale", "SELECT pid, round((coalesce(g, med) - avg(coalesce(g, med)) OVER ()) / stddev_samp(coalesce(g, med)) OVER (), 6) AS g, round((age - avg(age) OVER ()) / stddev_samp(age) OVER (), 6) AS age FROM (SELECT pid, age, CASE WHEN pid % 6 < 5 THEN edu::double END AS g, (SELECT median(CASE WHEN pid % 6 < 5 THEN edu::double END) FROM patients) AS med FROM patients)")
def x02(t):
    rows = t.patients.select("pid", "age", F.expr("CASE WHEN pid % 6 < 5 THEN double(edu) END").alias("g"), F.expr("CASE WHEN pid % 6 < 1 THEN edu END").alias("rare"))
    return x.impute_and_scale(rows, "pid", ["age", "g", "rare"]).select("pid", F.round("g", 6).alias("g"), F.round("age", 6).alias("age"))


@query("x03_completeness", "SELECT 'genotype' AS property, count(*) FILTER (WHERE genotype IS NULL) AS missing, round(count(*) FILTER (WHERE genotype IS NULL) / count(*), 6) AS share FROM patients UNION ALL SELECT 'segment', 0, 0.0::double FROM (SELECT 1)")
def x03(t):
    return r.missing_share(t.patients, ["genotype", "segment"])


@query("x04_partial_correlation", "SELECT 'age' AS a, 'edu' AS b, 'acctbal' AS given, round((ae - ab * eb) / sqrt((1 - ab * ab) * (1 - eb * eb)), 6) AS r FROM (SELECT corr(age, edu) AS ae, corr(age, acctbal) AS ab, corr(edu, acctbal) AS eb FROM patients) UNION ALL SELECT 'age', 'edu', NULL, round(corr(age, edu), 6) FROM patients")
def x04(t):
    return x.partial_correlations(t.patients, ["age", "edu", "acctbal"]).where("a = 'age' and b = 'edu'").select("a", "b", "given", "r")


_ALG = "SELECT DISTINCT concat('alg', k) AS algorithm, CASE WHEN k = 2 THEN b ELSE a END AS source, CASE WHEN k = 2 THEN a ELSE b END AS target, CASE WHEN k < 3 THEN 'directed' ELSE 'undirected' END AS direction FROM (SELECT line % 4 AS k, analyte AS a, CASE WHEN part % 3 = 0 THEN 'DX' WHEN part % 3 = 1 THEN 'MMSE' ELSE 'AGE' END AS b FROM facts GROUP BY 1, 2, 3 HAVING 2 * sum(abnormal) > count(*))"


def _algorithms(t):
    return t.spark.sql(_ALG.replace("FROM facts", "FROM {facts}"), facts=t.facts)


@query("x05_consensus", f"WITH e AS ({_ALG}), p AS (SELECT least(source, target) AS x, greatest(source, target) AS y, count(DISTINCT algorithm) AS k, count(*) FILTER (WHERE source < target) AS fx, count(*) FILTER (WHERE source > target) AS fy, bool_or(direction = 'directed') AS d FROM e GROUP BY ALL) SELECT CASE WHEN d AND fy > fx THEN y ELSE x END AS source, CASE WHEN d AND fy > fx THEN x ELSE y END AS target, d AS directed, round(k / (SELECT count(DISTINCT algorithm) FROM e), 6) AS confidence FROM p WHERE k >= 2")
def x05(t):
    return x.consensus(_algorithms(t)).select("source", "target", "directed", "confidence")


@query("x06_matrix_edges", "SELECT concat('v', n_regionkey) AS source, concat('v', k) AS target, CASE m WHEN 1 THEN '-->' WHEN 2 THEN '---' ELSE 'o->' END AS kind FROM (SELECT DISTINCT n_regionkey, k, (n_regionkey + k) % 4 AS m FROM nation, (SELECT unnest(range(5)) AS k)) WHERE m > 0")
def x06(t):
    rows = t.nation.select("n_regionkey").distinct().select("n_regionkey", F.expr("transform(sequence(0, 4), k -> int((n_regionkey + k) % 4))").alias("marks"))
    return x.matrix_edges(rows, [f"v{i}" for i in range(5)], "n_regionkey", "marks")


@query("x07_embed_edges", f"SELECT DISTINCT CASE source WHEN 'TAU' THEN 'loinc:30160-0' ELSE concat('cohort:', source) END AS src, 'CAUSES' AS type, concat('cohort:', target) AS dst FROM ({_ALG}) WHERE algorithm = 'alg1'")
def x07(t):
    uri = lambda c: F.coalesce(lookup(F.col(c), {"TAU": "loinc:30160-0"}), F.concat(F.lit("cohort:"), c))
    return _algorithms(t).where("algorithm = 'alg1'").select(uri("source").alias("src"), F.lit("CAUSES").alias("type"), uri("target").alias("dst")).distinct()


@query("x08_edge_validation", f"WITH e AS ({_ALG}), f AS (SELECT DISTINCT source, target FROM e WHERE algorithm = 'alg0'), g AS (SELECT DISTINCT source, target FROM e WHERE algorithm = 'alg1'), s AS (SELECT (SELECT count(*) FROM f SEMI JOIN g USING (source, target)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM g) AS ng) SELECT round(tp / nf, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * tp / (nf + ng), 6) AS f1, nf + ng - 2 * tp AS shd FROM s")
def x08(t):
    e = _algorithms(t)
    return x.edge_scores(e.where("algorithm = 'alg0'"), e.where("algorithm = 'alg1'"))


@query("x09_validated_flag", f"WITH e AS ({_ALG}) SELECT source, target FROM e a WHERE algorithm = 'alg0' AND EXISTS (SELECT 1 FROM e b WHERE b.algorithm = 'alg2' AND ((a.source = b.source AND a.target = b.target) OR (a.source = b.target AND a.target = b.source)))")
def x09(t):
    e = _algorithms(t)
    truth = e.where("algorithm = 'alg2'")
    both = truth.select("source", "target").unionByName(truth.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return e.where("algorithm = 'alg0'").join(both, ["source", "target"], "left_semi").select("source", "target")


@query("x10_backdoor_regression", "SELECT dx AS by_dx, n, round((syt * sxx - syx * sxt) / (stt * sxx - sxt * sxt), 6) AS effect FROM (SELECT dx, count(*) AS n, regr_sxx(mmse, months) AS stt, regr_sxx(mmse, price) AS sxx, regr_sxy(months, price) AS sxt, regr_sxy(mmse, months) AS syt, regr_sxy(mmse, price) AS syx FROM (SELECT dx, mmse, months, price / 100000 AS price FROM visits) GROUP BY 1)")
def x10(t):
    rows = t.visits.select("dx", "mmse", "months", F.expr("price / 100000").alias("price"))
    return x.effect(rows, "months", "mmse", ["price"], "dx").select(F.col("dx").alias("by_dx"), "n", "effect")


@query("x11_refuters")
def x11(t):
    """Hash-drawn permutations, which SQL of another engine can't repeat; tested by its properties."""
    rows = t.visits.select("vid", F.col("months").cast("double").alias("t"), (F.col("months") * 0.5 + F.col("mmse")).alias("y"), F.expr("price / 100000").alias("c"))
    return x.refuters(rows, "vid", "t", "y", ["c"])


@query("x12_causal_summary", f"SELECT algorithm, count(*) AS n, count(*) FILTER (WHERE direction = 'directed') AS directed FROM ({_ALG}) GROUP BY 1")
def x12(t):
    return _algorithms(t).groupBy("algorithm").agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "directed").alias("directed"))


@query("w12_moving_average", "SELECT vid, round(avg(mmse) OVER (PARTITION BY pid ORDER BY months, vid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m3 FROM visits")
def w12(t):
    return t.visits.select("vid", F.round(F.avg("mmse").over(Window.partitionBy("pid").orderBy("months", "vid").rowsBetween(-2, 0)), 6).alias("m3"))
