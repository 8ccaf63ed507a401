"""Queries of run audits, fit tables, representations and rosters."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import audits, catalogue, neighbours, provenance, reports
from fathom.operators.sampling import BASELINE_SEEDS
from fathom.operators.views import PATCH, normal, patches, table
from fathom.plans import roster
from fathom.plans.queries import r, register

# --- paths made of parts: retained from size, error from price, one flag in eleven wrong

_ERROR = "((p_partkey * 37) % 1000) / 1000.0::DOUBLE"
_POINTS = f"pt AS (SELECT p_partkey::DOUBLE AS lam, p_size AS retained, p_size - p_partkey % 3 AS nonzero, {_ERROR} AS error, p_size * 0.5::DOUBLE AS objective FROM part)"


def _points(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.cast("double").alias("lam"),
        F.col("p_size").alias("retained"),
        (F.col("p_size") - key % 3).alias("nonzero"),
        ((key * 37 % 1000) / F.lit(1000.0)).alias("error"),
        (F.col("p_size") * F.lit(0.5)).alias("objective"),
    )


@register(
    f"""WITH {_POINTS}, s AS (SELECT *, error <= 0.4 AND nonzero >= 5 AS due FROM pt), f AS (SELECT *, CASE WHEN lam::BIGINT % 11 = 0 THEN NOT due ELSE due END AS feasible FROM s)
SELECT lam, CASE WHEN retained < 5 OR retained > 40 THEN 'budget' ELSE 'feasibility' END AS problem FROM f WHERE retained < 5 OR retained > 40 OR feasible <> due"""
)
def path_violations(spark, sf_dir):
    p = _points(spark, sf_dir)
    due = (F.col("error") <= 0.4) & (F.col("nonzero") >= 5)
    return audits.path_violations(p.withColumn("feasible", F.when(F.col("lam") % 11 == 0, ~due).otherwise(due)), 5, 40, 0.4)


@register(
    f"""WITH {_POINTS}, c AS (SELECT lam, CASE WHEN lam::BIGINT % 50 = 0 THEN objective - 1 ELSE objective END AS objective, CASE WHEN lam::BIGINT % 30 = 0 THEN error - 0.01 ELSE error END AS error FROM pt WHERE lam::BIGINT % 97 <> 0)
SELECT pt.lam, CASE WHEN c.lam IS NULL THEN 'unmatched' WHEN pt.objective > c.objective + 1e-7 THEN 'objective' ELSE 'error' END AS problem
FROM pt LEFT JOIN c USING (lam) WHERE c.lam IS NULL OR pt.objective > c.objective + 1e-7 OR pt.error > c.error + 1e-7"""
)
def guard_violations(spark, sf_dir):
    p, lam = _points(spark, sf_dir), F.col("lam")
    lowered = {"objective": F.when(lam % 50 == 0, F.col("objective") - 1).otherwise(F.col("objective")), "error": F.when(lam % 30 == 0, F.col("error") - 0.01).otherwise(F.col("error"))}
    return audits.guard_violations(p, p.filter(lam % 97 != 0).withColumns(lowered))


@register(f"WITH {_POINTS} SELECT 1.0::DOUBLE AS lam, lam AS due FROM pt ORDER BY error > 0.4, CASE WHEN error <= 0.4 THEN retained ELSE 0 END, error, lam LIMIT 1")
def path_choice_audit(spark, sf_dir):
    return audits.wrong_choice(_points(spark, sf_dir), 0.4, spark.createDataFrame([(1.0,)], "lam double"))


@register(
    """WITH p AS (SELECT l_returnflag AS method, l_linestatus AS direction, l_linenumber % 3 - 1 AS slope, (l_orderkey % 21 - 10) * 0.5::DOUBLE AS change, 2.0::DOUBLE AS roundoff, l_partkey % 4 AS moved FROM lineitem)
SELECT method, direction, count(*) AS probes, sum((moved > 0)::INT)::BIGINT AS changed_neighbour, sum((abs(change) <= roundoff)::INT)::BIGINT AS within_roundoff, sum((slope < 0 AND change > roundoff)::INT)::BIGINT AS resolved_rises FROM p GROUP BY ALL"""
)
def probe_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("method"),
        F.col("l_linestatus").alias("direction"),
        (F.col("l_linenumber") % 3 - 1).alias("slope"),
        ((F.col("l_orderkey") % 21 - 10) * F.lit(0.5)).alias("change"),
        F.lit(2.0).alias("roundoff"),
        (F.col("l_partkey") % 4).alias("moved"),
    )
    return audits.probe_summary(rows)


# --- representations

_COLUMNS = {"all": 64, "half": 32, "first": 16}
_SCORES = f"""{PATCH}, s AS (SELECT vec_id, image_id, role, y, method, v[1:k] AS v FROM patch, (VALUES {", ".join(f"('{m}', {k})" for m, k in _COLUMNS.items())}) AS t(method, k)),
d AS (SELECT q.method, q.vec_id, q.image_id, 1 - max(list_dot_product(q.v, m.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(m.v, m.v))) AS distance
  FROM s q JOIN s m ON q.method = m.method AND q.role = 'holdout' AND q.y = 0 AND m.role = 'fit' AND m.y = 0 GROUP BY ALL)"""


@register(
    f"""WITH {_SCORES}, i AS (SELECT method, image_id, avg(distance) AS score FROM (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY method, image_id) AS n FROM d WINDOW w AS (PARTITION BY method, image_id ORDER BY distance DESC, vec_id))
  WHERE place <= greatest(1, ceil(n * 0.4)) GROUP BY ALL),
p AS (SELECT a.method, avg((a.distance - t.distance) * (a.distance - t.distance)) AS pm FROM d a JOIN d t ON t.vec_id = a.vec_id AND t.method = 'all' GROUP BY 1),
g AS (SELECT a.method, count(*) AS images, avg((a.score - t.score) * (a.score - t.score)) AS im, avg(a.score) AS ms, avg(t.score * t.score) AS tt FROM i a JOIN i t ON t.image_id = a.image_id AND t.method = 'all' GROUP BY 1)
SELECT method, images, round(im, 6) AS image_score_mse, round(pm, 6) AS patch_score_mse, round(ms, 6) AS mean_score, round(im / greatest(tt, 1e-4), 6) AS relative_mse FROM g JOIN p USING (method)"""
)
def representation_errors(spark, sf_dir):
    rows = patches(spark, sf_dir)

    def scored(method: str, k: int) -> DataFrame:
        cut = rows.withColumn("v", F.slice("v", 1, k))
        found = neighbours.nearest(normal(cut, "holdout"), normal(cut, "fit"))
        own = normal(rows, "holdout").select("vec_id", "image_id")
        return own.join(found.select(F.col("query_id").alias("vec_id"), (1 - F.col("cosine")).alias("distance")), "vec_id").withColumn("method", F.lit(method))

    scores = functools.reduce(DataFrame.unionByName, (scored(m, k) for m, k in _COLUMNS.items()))
    out = audits.representation_errors(scores, "all", 0.4)
    return out.select("method", "images", *(r(c).alias(c) for c in ("image_score_mse", "patch_score_mse", "mean_score", "relative_mse")))


@register(
    f"""WITH {PATCH}, l AS (SELECT vec_id, v[1:16] AS a, v[33:48] AS b FROM patch), u AS (SELECT vec_id, a, b, greatest(sqrt(list_dot_product(a, a)), 1e-12) AS na, greatest(sqrt(list_dot_product(b, b)), 1e-12) AS nb FROM l),
z AS (SELECT vec_id, a[1] / na * sqrt(0.5) AS x, a[6] / na * sqrt(0.3) AS y, b[5] / nb * sqrt(0.2) AS w FROM u) SELECT vec_id, round(x / greatest(sqrt(x * x + y * y + w * w), 1e-12), 6) AS x, round(y / greatest(sqrt(x * x + y * y + w * w), 1e-12), 6) AS y, round(w / greatest(sqrt(x * x + y * y + w * w), 1e-12), 6) AS w FROM z"""
)
def represented_support(spark, sf_dir):
    """Two unit layers, three weighted columns, unit length: a method as the evaluation applies it."""
    from fathom.operators.transforms import Method, represent

    method = Method("main", "support", (0, 2), "l2", (0, 5, 20), (0.5, 0.3, 0.2))
    out = represent(patches(spark, sf_dir), method, 16)
    return out.select("vec_id", *(r(F.get("v", F.lit(k))).alias(c) for k, c in enumerate("xyw")))


@register(f"WITH {PATCH}, c AS (SELECT unnest(v) AS x, unnest(range(64)) AS j FROM patch WHERE role = 'fit' AND y = 0), s AS (SELECT var_pop(x) AS var FROM c GROUP BY j) SELECT round(sum(var), 6) AS whole, 0.0::DOUBLE AS off FROM s")
def pca_whole_variance(spark, sf_dir):
    """All components together carry the columns' variance, and each carries its eigenvalue."""
    from fathom.operators.transforms import fit_pca, project

    rows = normal(patches(spark, sf_dir), "fit").select("vec_id", "v")
    pca = fit_pca(rows, 64)
    spread = project(rows, pca).select(F.posexplode("z").alias("j", "x")).groupBy("j").agg(F.var_pop("x").alias("var"))
    known = spark.createDataFrame([(k, float(x)) for k, x in enumerate(pca.variances)], "j int, eigenvalue double")
    return spread.join(known, "j").agg(r(F.sum("var")).alias("whole"), r(F.max(F.abs(F.col("var") - F.col("eigenvalue")))).alias("off"))


# --- independent fits: customers dealt to three fits, priorities as methods

_FITS = """m AS (SELECT (o_custkey % 3)::INT AS fit, n_name AS dataset, CASE WHEN o_orderkey % 3 = 0 THEN 'x_main' ELSE 'x_random_seed' || (o_orderkey % 3) END AS method, avg(o_totalprice::DOUBLE / 600000) AS auroc
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
f AS (SELECT fit, dataset, CASE WHEN method = 'x_main' THEN 'main' ELSE 'random' END AS family, avg(auroc) AS mean, coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(auroc) END, 0) AS within_sd, count(*) AS members FROM m GROUP BY ALL),
g AS (SELECT fit, family, avg(mean) AS mean FROM f GROUP BY ALL)"""


def _fit_tables(spark, sf_dir) -> dict[str, DataFrame]:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey") % 3
    method = F.when(k == 0, "x_main").otherwise(F.concat(F.lit("x_random_seed"), k.cast("string")))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    metric = rows.groupBy((F.col("o_custkey") % 3).cast("int").alias("fit"), F.col("n_name").alias("dataset"), method.alias("method")).agg(F.avg(F.col("o_totalprice").cast("double") / 600000).alias("auroc"))
    return audits.fit_tables(metric, audits.family_members(spark, ["x_main", "x_random_seed1", "x_random_seed2"], "x_", [1, 2]), "auroc", "main")


@register(f"WITH {_FITS} SELECT fit, dataset, family, round(mean, 6) AS mean, round(within_sd, 6) AS within_sd, members FROM f")
def fit_family_means(spark, sf_dir):
    return _fit_tables(spark, sf_dir)["families"].select("fit", "dataset", "family", r("mean").alias("mean"), r("within_sd").alias("within_sd"), "members")


@register(f"WITH {_FITS} SELECT a.fit, a.dataset, a.family, round(b.mean - a.mean, 6) AS delta FROM f a JOIN f b ON a.fit = b.fit AND a.dataset = b.dataset AND b.family = 'main' AND a.family <> 'main'")
def fit_deltas(spark, sf_dir):
    return _fit_tables(spark, sf_dir)["deltas"].select("fit", "dataset", "family", r("delta").alias("delta"))


@register(f"WITH {_FITS}, e AS (SELECT a.fit, a.family, b.mean - a.mean AS delta FROM g a JOIN g b ON a.fit = b.fit AND b.family = 'main' AND a.family <> 'main') SELECT family, printf('%+.3f ± %.3f', avg(delta) * 100, stddev_samp(delta) * 100) AS shown FROM e GROUP BY family")
def fit_summary(spark, sf_dir):
    return audits.summary_table(_fit_tables(spark, sf_dir)["macro_deltas"], ["family"], "delta", 3)


@register(
    """WITH m AS (SELECT s_nationkey AS dataset, s_suppkey % 3 AS branch, 'k' || (s_suppkey % 4) AS key, (s_suppkey // 12 % 2)::VARCHAR AS value FROM supplier),
b AS (SELECT dataset, count(DISTINCT branch) AS branches FROM m GROUP BY 1), k AS (SELECT dataset, key, count(DISTINCT branch) AS present, count(DISTINCT value) AS "values" FROM m GROUP BY ALL)
SELECT dataset, key, present, "values" FROM k JOIN b USING (dataset) WHERE present < branches OR "values" > 1"""
)
def protocol_differences(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dataset"), (k % 3).alias("branch"), F.concat(F.lit("k"), (k % 4).cast("string")).alias("key"), F.expr("cast(s_suppkey div 12 % 2 as string)").alias("value"))
    return audits.protocol_differences(rows, "dataset")


# --- rosters, coverage, provenance


def _roster_sql() -> str:
    parts = []
    for mode, mark in roster.MODES.items():
        for objective, own in roster.PER_OBJECTIVE.items():
            prefix = "" if (objective, mode) == ("matching", "l2") else f"{mark}{objective}_"
            parts += [f"('{prefix}', '{m}')" for m in (*roster.COMMON, *own)]
    seeds = ", ".join(f"({s})" for s in BASELINE_SEEDS)
    return f"WITH m(prefix, name) AS (VALUES {', '.join(parts)}), s(seed) AS (VALUES {seeds}) SELECT prefix || name AS method FROM m WHERE name NOT LIKE '%*' UNION ALL SELECT prefix || replace(name, '*', '') || '_seed' || seed FROM m, s WHERE name LIKE '%*'"


@register(_roster_sql())
def method_roster(spark, sf_dir):
    return spark.createDataFrame([(m,) for m in roster.roster(roster.branches())], "method string")


@register("WITH s AS (SELECT s_nationkey AS dataset, CASE WHEN s_suppkey % 3 = 0 THEN 'complete' ELSE 'fit' END AS stage FROM supplier), m AS (SELECT DISTINCT c_nationkey AS dataset FROM customer WHERE c_custkey % 20 = 0), d AS (SELECT DISTINCT dataset FROM s WHERE stage = 'complete') (SELECT * FROM d EXCEPT SELECT * FROM m) UNION ALL (SELECT * FROM m EXCEPT SELECT * FROM d)")
def completed_scope(spark, sf_dir):
    stages = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("dataset"), F.when(F.col("s_suppkey") % 3 == 0, "complete").otherwise("fit").alias("stage"))
    return provenance.completed_scope(stages, table(spark, sf_dir, "customer").filter("c_custkey % 20 = 0").select(F.col("c_nationkey").alias("dataset")))


@register("SELECT n_nationkey AS dataset, n_name AS value FROM nation")
def merged_workers(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dataset"), F.col("n_name").alias("value"))
    everyone = {row[0] for row in rows.select("dataset").collect()}  # one row a dataset
    return provenance.merged([rows.filter(F.col("dataset") % 2 == k) for k in (0, 1)], everyone)


@register("SELECT count(CASE WHEN toxic = 1 THEN 1 END) AS abnormal, count(CASE WHEN toxic = 1 AND doc_id % 7 <> 0 THEN 1 END) AS with_mask, count(CASE WHEN toxic = 1 AND doc_id % 7 = 0 THEN 1 END) AS uncovered FROM labels")
def mask_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("toxic").alias("label"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")).alias("mask_path"))
    return catalogue.mask_coverage(rows).crossJoin(catalogue.uncovered(rows).agg(F.count("*").alias("uncovered")))  # one row each


@register("SELECT p_partkey, round(1 - p_size / 384.0, 9) AS compression, round(20000 * p_size * 2 / 1048576.0, 9) AS mib FROM part")
def memory_compression(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(reports.compression(size, F.lit(384.0)), 9).alias("compression"), F.round(reports.memory_mib(F.lit(20_000), size), 9).alias("mib"))


@register("WITH p AS (SELECT DISTINCT c_mktsegment AS dataset, 'm' || (c_nationkey % 9 + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS method FROM customer) SELECT method, count(*) AS present FROM p GROUP BY method HAVING count(*) < (SELECT count(DISTINCT dataset) FROM p)")
def unequal_method_sets(spark, sf_dir):
    number = F.col("c_nationkey") % 9 + F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dataset"), F.concat(F.lit("m"), number.cast("string")).alias("method"))
    return reports.unequal_method_sets(rows, "dataset")
