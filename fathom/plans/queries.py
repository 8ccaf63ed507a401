"""Registered queries of the engine's own operators, each with its DuckDB equivalent.

Every query runs over whole tables.  Values are rounded on both sides where sums may differ in the last
digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.vectors import dot, l2_normalized, layer, take
from fathom.operators import losses, metrics, neighbours, reports, selection, statistics
from fathom.operators.views import COORD, LAYER, LAYER_WIDTH, LAYERS, PATCH, PERTURBED, coordinates, layer_vectors, normal, patches, perturbed, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def r(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


#: Fit rows without abnormal ones are the memory; test rows are the queries.
MEMORY, TEST = "role = 'fit' AND y = 0", "role = 'test'"
DIST = f"""dist AS (
  SELECT q.vec_id, q.image_id, q.y, 1 - least(1.0, greatest(-1.0, max(list_dot_product(q.v, m.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(m.v, m.v)))))) AS distance
  FROM (SELECT * FROM patch WHERE {TEST}) q, (SELECT * FROM patch WHERE {MEMORY}) m GROUP BY ALL)"""
IMAGE = """img AS (
  SELECT image_id, avg(distance) AS score, max(ymax) AS y FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY distance DESC, vec_id) AS place, count(*) OVER (PARTITION BY image_id) AS n, max(y) OVER (PARTITION BY image_id) AS ymax FROM dist)
  WHERE place <= greatest(1, ceil(n * {fraction})) GROUP BY image_id)"""
IMG = IMAGE.format(fraction=0.4)


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patches(spark, sf_dir)
    tests = rows.filter(F.col("role") == "test")
    found = neighbours.nearest(tests, normal(rows, "fit"))
    return tests.select("vec_id", "image_id", "y").join(found.select(F.col("query_id").alias("vec_id"), "ref_id", (1 - F.col("cosine")).alias("distance")), "vec_id")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _distances(spark, sf_dir)
    truth = d.groupBy("image_id").agg(F.max("y").alias("y"))
    return neighbours.image_scores(d, 0.4).join(truth, "image_id")


# --- scoring


@register(f"WITH {PATCH}, {DIST} SELECT vec_id, image_id, y, round(distance, 6) AS distance FROM dist")
def knn_patch_distance(spark, sf_dir):
    return _distances(spark, sf_dir).select("vec_id", "image_id", "y", r("distance").alias("distance"))


@register(f"WITH {PATCH}, {DIST}, {IMG} SELECT image_id, y, round(score, 6) AS score FROM img")
def knn_image_score(spark, sf_dir):
    return _images(spark, sf_dir).select("image_id", "y", r("score").alias("score"))


@register(
    f"""WITH {PATCH}, {DIST}, {IMG}, s AS (SELECT round(score, 9) AS s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM img GROUP BY 1),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(pos + neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT sum(pos) AS positives, sum(neg) AS negatives, round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auroc, round(sum(pos * tp / n) / sum(pos), 6) AS ap FROM w"""
)
def knn_detection_metrics(spark, sf_dir):
    rows = _images(spark, sf_dir).select("y", r("score", 9).alias("s"))
    return metrics.ranking_metrics(rows).select("positives", "negatives", r("auroc").alias("auroc"), r("ap").alias("ap"))


@register(
    f"""WITH {PATCH}, p AS (SELECT q.vec_id AS query_id, m.vec_id AS ref_id, list_dot_product(q.v, m.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(m.v, m.v))) AS c
  FROM patch q JOIN patch m ON q.image_id <> m.image_id WHERE q.role = 'fit' AND q.y = 0 AND m.role = 'fit' AND m.y = 0)
SELECT query_id, round(greatest(0, 1 - max(c)), 6) AS distance FROM p GROUP BY query_id"""
)
def knn_leave_image_out(spark, sf_dir):
    rows = normal(patches(spark, sf_dir), "fit")
    return neighbours.nearest(rows, rows, 1, other_group=True).select("query_id", r(F.greatest(F.lit(0.0), 1 - F.col("cosine"))).alias("distance"))


_PAIRS = """pairs AS (SELECT q.vec_id AS query_id, m.vec_id AS ref_id, least(1.0, list_dot_product(q.v, m.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(m.v, m.v)))) AS c
  FROM patch q JOIN patch m ON q.image_id <> m.image_id WHERE q.role = 'holdout' AND q.y = 0 AND m.role = 'fit' AND m.y = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, ref_id) AS rank FROM pairs)"""


@register(f"WITH {PATCH}, {_PAIRS} SELECT query_id, rank::INT AS rank, ref_id, round(c, 6) AS cosine FROM ranked WHERE rank <= 5")
def knn_topk_neighbours(spark, sf_dir):
    rows = patches(spark, sf_dir)
    return neighbours.nearest(normal(rows, "holdout"), normal(rows, "fit"), 5, other_group=True).select("query_id", "rank", "ref_id", r("cosine").alias("cosine"))


@register(
    f"WITH {PATCH}, {_PAIRS} SELECT query_id, min_by(ref_id, rank) AS near_id, max_by(ref_id, rank) AS far_id, round(max(c), 6) AS near_cosine, round(min(c), 6) AS far_cosine FROM ranked WHERE rank <= 8 GROUP BY query_id"
)
def neighbour_near_far(spark, sf_dir):
    rows = patches(spark, sf_dir)
    found = neighbours.near_far(normal(rows, "holdout"), normal(rows, "fit"), 8)
    return found.select("query_id", "near_id", "far_id", r("near_cosine").alias("near_cosine"), r("far_cosine").alias("far_cosine"))


@register(
    f"""WITH {PATCH}, {_PAIRS.replace("q.role = 'holdout'", "q.role = 'fit'")}, gaps AS (SELECT query_id, max(c) - min(c) AS gap FROM ranked WHERE rank <= 8 GROUP BY query_id)
SELECT round(greatest(0.01, quantile_disc(gap, 0.5)), 6) AS temperature FROM gaps"""
)
def normal_temperature(spark, sf_dir):
    return neighbours.temperature(normal(patches(spark, sf_dir), "fit")).select(r("temperature").alias("temperature"))


@register(
    f"""WITH {PATCH}, {_PAIRS}, halves AS (
  SELECT s AS subset, q.vec_id AS query_id, m.vec_id AS ref_id,
    list_dot_product(q.v[32 * s + 1 : 32 * s + 32], m.v[32 * s + 1 : 32 * s + 32]) / (sqrt(list_dot_product(q.v[32 * s + 1 : 32 * s + 32], q.v[32 * s + 1 : 32 * s + 32])) * sqrt(list_dot_product(m.v[32 * s + 1 : 32 * s + 32], m.v[32 * s + 1 : 32 * s + 32]))) AS c
  FROM patch q JOIN patch m ON q.image_id <> m.image_id, (SELECT unnest(range(2)) AS s) WHERE q.role = 'holdout' AND q.y = 0 AND m.role = 'fit' AND m.y = 0),
seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subset, query_id ORDER BY c DESC, ref_id) AS rank FROM halves) WHERE rank <= 8)
SELECT query_id, ref_id, count(DISTINCT subset) AS votes, count(DISTINCT subset) / 2.0::DOUBLE AS weight FROM (SELECT * FROM ranked WHERE rank <= 8) JOIN seen USING (query_id, ref_id) GROUP BY query_id, ref_id HAVING count(DISTINCT subset) >= 1"""
)
def stable_neighbour_votes(spark, sf_dir):
    rows = patches(spark, sf_dir)
    return neighbours.stable_votes(normal(rows, "holdout"), normal(rows, "fit"), [list(range(32)), list(range(32, 64))], 8, 1)


@register(
    f"""WITH {PATCH}, {_PAIRS}, two AS (SELECT query_id, max(CASE WHEN rank = 1 THEN c END) AS a, max(CASE WHEN rank = 2 THEN c END) AS b FROM ranked WHERE rank <= 2 GROUP BY query_id)
SELECT count(*) AS queries, round(min(a - b), 6) AS least_gap, round(avg(a - b), 6) AS mean_gap, sum((a = b)::INT)::BIGINT AS ties FROM two"""
)
def neighbour_gap_summary(spark, sf_dir):
    rows = patches(spark, sf_dir)
    two = neighbours.nearest(normal(rows, "holdout"), normal(rows, "fit"), 2, other_group=True).groupBy("query_id").agg(F.max("cosine").alias("a"), F.min("cosine").alias("b"))
    gap = F.col("a") - F.col("b")
    return two.agg(F.count("*").alias("queries"), r(F.min(gap)).alias("least_gap"), r(F.avg(gap)).alias("mean_gap"), F.sum((gap == 0).cast("long")).alias("ties"))


@register(f"WITH {PATCH}, {DIST}, {IMAGE.format(fraction=0.01)} SELECT image_id, round(score, 6) AS score FROM img")
def image_topk_mean(spark, sf_dir):
    return neighbours.image_scores(_distances(spark, sf_dir), 0.01).select("image_id", r("score").alias("score"))


# --- ranking metrics with ties

_TIED = "t AS (SELECT n_chars AS s, toxic AS y, 1.0::DOUBLE AS w FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"
_RANKED = """g AS (SELECT s, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM t GROUP BY s),
k AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos + neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS n FROM g)"""


def _tied(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("toxic is not null").select(F.col("n_chars").cast("double").alias("s"), F.col("toxic").alias("y"), "lang", "doc_id")


@register(f"WITH {_TIED}, {_RANKED} SELECT sum(pos) AS positives, sum(neg) AS negatives, round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 9) AS auroc FROM k")
def auroc_ties(spark, sf_dir):
    return metrics.ranking_metrics(_tied(spark, sf_dir)).select("positives", "negatives", r("auroc", 9).alias("auroc"))


@register(f"WITH {_TIED}, {_RANKED} SELECT round(sum(CASE WHEN pos > 0 THEN pos * tp / n ELSE 0 END) / sum(pos), 9) AS ap FROM k")
def average_precision_ties(spark, sf_dir):
    return metrics.ranking_metrics(_tied(spark, sf_dir)).select(r("ap", 9).alias("ap"))


@register(
    f"WITH {_TIED.replace('1.0::DOUBLE', '(1 + doc_id % 3)::DOUBLE')}, {_RANKED} SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 9) AS auroc, round(sum(CASE WHEN pos > 0 THEN pos * tp / n ELSE 0 END) / sum(pos), 9) AS ap FROM k"
)
def weighted_auroc(spark, sf_dir):
    return metrics.ranking_metrics(_tied(spark, sf_dir), weight=(1 + F.col("doc_id") % 3).cast("double")).select(r("auroc", 9).alias("auroc"), r("ap", 9).alias("ap"))


@register(
    """WITH t AS (SELECT lang, n_chars AS s, toxic AS y FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
g AS (SELECT lang, s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM t GROUP BY lang, s),
k AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY lang ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos + neg) OVER (PARTITION BY lang ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT lang, sum(pos) AS positives, sum(neg) AS negatives, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END, 9) AS auroc,
  round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * tp / n ELSE 0 END) / sum(pos) END, 9) AS ap FROM k GROUP BY lang"""
)
def ranking_metrics_by_group(spark, sf_dir):
    return metrics.ranking_metrics(_tied(spark, sf_dir), ["lang"]).select("lang", "positives", "negatives", r("auroc", 9).alias("auroc"), r("ap", 9).alias("ap"))


@register()
def bootstrap_ci(spark, sf_dir):
    """Paired intervals of two scores under label-stratified weights."""
    local = _tied(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size")), "doc_id").select("y", "s", "size").toPandas()  # one row an evaluated image
    scores = {"chars": local["s"].to_numpy(), "half_seed1": (local["size"] // 2).to_numpy(), "half_seed2": (local["size"] // 3).to_numpy()}
    drawn = metrics.bootstrap_draws(spark, local["y"].to_numpy(), scores, {"chars": ["chars"], "half": ["half_seed1", "half_seed2"]})
    return metrics.paired_intervals(drawn, "chars")


# --- tails and clustered errors

_VALUES = "e AS (SELECT user_id, value AS x, event_type FROM events WHERE value IS NOT NULL)"


def _values(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value is not null").select("user_id", F.col("value").alias("x"), "event_type")


@register(
    f"""WITH {_VALUES}, k AS (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY x DESC) AS place, count(*) OVER (PARTITION BY event_type) * 0.25::DOUBLE AS mass FROM e)
SELECT event_type, round(sum(least(1.0, greatest(0.0, mass - (place - 1))) * x) / max(mass), 6) AS cvar FROM k GROUP BY event_type"""
)
def cvar_fractional(spark, sf_dir):
    return statistics.upper_tail_mean(_values(spark, sf_dir), ["event_type"], 0.25).select("event_type", r("cvar").alias("cvar"))


@register(
    f"""WITH {_VALUES}, m AS (SELECT avg(x) AS m, count(*) AS n FROM e), g AS (SELECT user_id, sum(x - m) AS d, max(m) AS m, max(n) AS n FROM e, m GROUP BY user_id)
SELECT round(max(m), 6) AS mean, round(sqrt(count(*) / (count(*) - 1)::DOUBLE * sum(d * d)) / max(n), 6) AS se FROM g"""
)
def cluster_mean_se(spark, sf_dir):
    return statistics.cluster_standard_error(_values(spark, sf_dir), "user_id").select(r("mean").alias("mean"), r("se").alias("se"))


# --- variability, norms and Gram statistics

_VAR = f"""WITH {PATCH}, {PERTURBED}, both_ AS (SELECT kind, unnest(v) AS x, unnest(w) AS z, unnest(range(64)) AS j FROM perturbed WHERE role = 'fit' AND y = 0)
SELECT kind, j::INT AS j, round(avg((z - x) * (z - x)) / (var_pop(x) + 1e-6), 6) AS ratio, count(*) AS n FROM both_ {{where}} GROUP BY kind, j"""


def _pairs(spark, sf_dir):
    return perturbed(normal(patches(spark, sf_dir), "fit"))


@register(_VAR.format(where="WHERE kind = 'gamma'"))
def variability_gamma(spark, sf_dir):
    return statistics.variability(_pairs(spark, sf_dir).filter("kind = 'gamma'"), ["kind"]).select("kind", "j", r("ratio").alias("ratio"), "n")


@register(_VAR.format(where=""))
def variability_all_kinds(spark, sf_dir):
    return statistics.variability(_pairs(spark, sf_dir), ["kind"]).select("kind", "j", r("ratio").alias("ratio"), "n")


@register(f"WITH {PATCH}, n AS (SELECT sqrt(list_dot_product(v, v)) AS n FROM patch) SELECT round(min(n), 6) AS least, round(max(n), 6) AS most, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd FROM n")
def row_norm_stats(spark, sf_dir):
    return statistics.norm_summary(patches(spark, sf_dir)).select(*(r(c).alias(c) for c in ("least", "most", "mean", "sd")))


@register(
    f"""WITH {PATCH}, {COORD}, e AS (SELECT j, avg(x * x) AS energy FROM coord WHERE role = 'fit' AND y = 0 GROUP BY j)
SELECT j::INT AS j, round(energy, 9) AS energy, row_number() OVER (ORDER BY round(energy, 9) DESC, j)::INT AS place FROM e QUALIFY row_number() OVER (ORDER BY round(energy, 9) DESC, j) <= 10"""
)
def column_energy_topk(spark, sf_dir):
    e = coordinates(normal(patches(spark, sf_dir), "fit")).groupBy("j").agg(r(F.avg(F.col("x") * F.col("x")), 9).alias("energy"))
    return e.withColumn("place", F.row_number().over(Window.orderBy(F.desc("energy"), "j"))).filter("place <= 10")


@register(
    f"""WITH {PATCH}, {COORD} SELECT a.j::INT AS i, b.j::INT AS j, round(avg(a.x * b.x), 8) AS g FROM (SELECT * FROM coord WHERE role = 'fit' AND y = 0) a JOIN coord b ON a.vec_id = b.vec_id AND a.j <= b.j GROUP BY a.j, b.j"""
)
def gram_matrix(spark, sf_dir):
    """From one partial product a task, as a table."""
    g = statistics.gram(normal(patches(spark, sf_dir), "fit"))
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(len(g)) for j in range(i, len(g))], "i int, j int, g double").select("i", "j", r("g", 8).alias("g"))


_CMP = f"""WITH {PATCH}, rows_ AS (SELECT vec_id, v AS a, v[1:32] AS b FROM patch WHERE role = 'holdout' AND y = 0),
p AS (SELECT q.vec_id AS q, m.vec_id AS r, list_dot_product(q.a, m.a) / (sqrt(list_dot_product(q.a, q.a)) * sqrt(list_dot_product(m.a, m.a))) AS t, list_dot_product(q.b, m.b) / (sqrt(list_dot_product(q.b, q.b)) * sqrt(list_dot_product(m.b, m.b))) AS s
  FROM rows_ q JOIN rows_ m ON q.vec_id <> m.vec_id),
b AS (SELECT q, sum((s - t) * (s - t)) AS off_, sum(t * t) AS on_, max(t) AS best, arg_max(t, s) AS got, arg_max(r, t) AS rt, arg_max(r, s) AS rs FROM p GROUP BY q)
SELECT {{out}} FROM b"""


def _compared(spark, sf_dir):
    rows = normal(patches(spark, sf_dir), "holdout").select("vec_id", "v")
    return statistics.compare_neighbourhoods(rows, rows.withColumn("v", F.slice("v", 1, 32)))


@register(_CMP.format(out="round(sqrt(sum(off_) / (sum(on_) + count(*))), 6) AS relative_error"))
def gram_relative_error(spark, sf_dir):
    return _compared(spark, sf_dir).select(r("relative_error").alias("relative_error"))


@register(_CMP.format(out="round(avg((rt = rs)::INT), 6) AS agreement, round(avg(best - got), 6) AS regret"))
def nn_agreement_regret(spark, sf_dir):
    return _compared(spark, sf_dir).select(r("agreement").alias("agreement"), r("regret").alias("regret"))


# --- layers

_Q = f"""WITH {PATCH}, {LAYER}, c AS (SELECT vec_id, layer, unnest(vec) AS x, unnest(range(16)) AS j FROM layer_vec WHERE role = 'fit' AND y = 0),
g AS (SELECT a.layer AS l, b.layer AS m, a.j AS i, b.j AS j, sum(a.x * b.x) AS g FROM c a JOIN c b USING (vec_id) GROUP BY ALL), q AS (SELECT l, m, sum(g * g) AS q FROM g GROUP BY l, m)"""


def _inner_products(spark, sf_dir):
    q = statistics.layer_inner_products(normal(patches(spark, sf_dir), "fit"), LAYERS, LAYER_WIDTH)
    return spark.createDataFrame([(a, b, float(q[a, b])) for a in range(LAYERS) for b in range(LAYERS)], "l int, m int, q double")


@register(f"{_Q} SELECT l::INT AS l, m::INT AS m, round(q, 4) AS q FROM q")
def layer_inner_products(spark, sf_dir):
    return _inner_products(spark, sf_dir).select("l", "m", r("q", 4).alias("q"))


_SUBSETS = "subsets AS (SELECT s::INT AS subset, l FROM (SELECT unnest(range(1, 16)) AS s), (SELECT unnest(range(4)) AS l) WHERE (s >> l) & 1 = 1)"


def _subsets(spark, least=1):
    """``subset, l, size``: a bridge from every layer subset (as a bit mask) to its layers."""
    rows = [(s, k, s.bit_count()) for s in range(1, 1 << LAYERS) if s.bit_count() >= least for k in range(LAYERS) if s >> k & 1]
    return spark.createDataFrame(rows, "subset int, l int, size int")


@register(
    f"""{_Q}, {_SUBSETS}, sz AS (SELECT subset, count(*) AS k FROM subsets GROUP BY subset),
d AS (SELECT sz.subset, n.l, CASE WHEN s.l IS NULL THEN 0.0 ELSE 1.0::DOUBLE / k END - 0.25 AS d FROM sz CROSS JOIN (SELECT unnest(range(4)) AS l) n LEFT JOIN subsets s ON s.subset = sz.subset AND s.l = n.l)
SELECT a.subset, round(sqrt(greatest(0, sum(a.d * b.d * q))) / (SELECT sqrt(sum(q) / 16) FROM q), 6) AS error FROM d a JOIN d b ON a.subset = b.subset JOIN q ON q.l = a.l AND q.m = b.l GROUP BY a.subset"""
)
def layer_subset_error(spark, sf_dir):
    q = _inner_products(spark, sf_dir)
    bridge = _subsets(spark)
    grid = bridge.select("subset", "size").distinct().crossJoin(spark.range(LAYERS).select(F.col("id").cast("int").alias("l")))
    has = bridge.select("subset", "l", F.lit(1).alias("has"))
    d = grid.join(has, ["subset", "l"], "left").select("subset", "l", (F.when(F.col("has") == 1, 1 / F.col("size")).otherwise(0.0) - 1 / LAYERS).alias("d"))
    both = d.join(d.select("subset", F.col("l").alias("m"), F.col("d").alias("e")), "subset").join(q, ["l", "m"])
    whole = q.agg((F.sqrt(F.sum("q")) / LAYERS).alias("whole"))
    err = both.groupBy("subset").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("d") * F.col("e") * F.col("q")))).alias("e"))
    return err.crossJoin(whole).select("subset", r(F.col("e") / F.col("whole")).alias("error"))


_EDGES = f"""WITH {PATCH}, {LAYER}, {_PAIRS}, e AS (SELECT query_id, min_by(ref_id, rank) AS near, max_by(ref_id, rank) AS far, max(c) AS tn, min(c) AS tf FROM ranked WHERE rank <= 8 GROUP BY query_id),
wd AS (SELECT *, least(4.0, 1 + (1 - tn) / greatest(avg(1 - tn) OVER (), 1e-4)) AS raw FROM e), ww AS (SELECT *, raw / avg(raw) OVER () AS w FROM wd),
scale AS (SELECT greatest(avg(sq), 1e-4) AS scale FROM (SELECT (1 - tn) * (1 - tn) AS sq FROM ww UNION ALL SELECT (1 - tf) * (1 - tf) FROM ww)),
ends AS (SELECT query_id, near AS ref_id, 'near' AS side FROM ww UNION ALL SELECT query_id, far, 'far' FROM ww),
lay AS (SELECT query_id, side, q.layer, list_dot_product(q.vec, m.vec) AS ab, list_dot_product(q.vec, q.vec) AS aa, list_dot_product(m.vec, m.vec) AS bb FROM ends JOIN layer_vec q ON q.vec_id = query_id JOIN layer_vec m ON m.vec_id = ref_id AND m.layer = q.layer),
{_SUBSETS}, cs AS (SELECT subset, query_id, side, sum(ab) / sqrt(sum(aa) * sum(bb)) AS c FROM lay JOIN subsets ON l = layer GROUP BY ALL),
wide AS (SELECT subset, query_id, max(CASE WHEN side = 'near' THEN c END) AS cn, max(CASE WHEN side = 'far' THEN c END) AS cf FROM cs GROUP BY ALL)"""


@register(
    f"""{_EDGES} SELECT subset, round(sum(w * ((cn - tn) * (cn - tn) + (cf - tf) * (cf - tf))) / (2 * count(*)) / max(scale) + avg(w * greatest(0, tn - tf - cn + cf) * greatest(0, tn - tf - cn + cf)) / max(scale), 6) AS score
FROM wide JOIN ww USING (query_id), scale WHERE bit_count(subset) >= 2 GROUP BY subset"""
)
def layer_subset_local_score(spark, sf_dir):
    """Every subset of two or more layers scored on the holdout from one table of per-layer products."""
    rows = patches(spark, sf_dir)
    edges = neighbours.near_far(normal(rows, "holdout"), normal(rows, "fit"), 8)
    distance = edges.select("query_id", (1 - F.col("near_cosine")).alias("distance"))
    weights = statistics.query_weights(distance)
    edges = edges.join(weights, "query_id")
    sq = lambda c: (1 - F.col(c)) * (1 - F.col(c))
    scale = edges.agg(F.greatest((F.sum(sq("near_cosine")) + F.sum(sq("far_cosine"))) / (2 * F.count("*")), F.lit(1e-4)).alias("scale"))
    ends = edges.select("query_id", F.explode(F.array(F.struct(F.lit("near").alias("side"), F.col("near_id").alias("ref_id")), F.struct(F.lit("far").alias("side"), F.col("far_id").alias("ref_id")))).alias("e")).select("query_id", "e.*")
    parts = [l2_normalized(layer("v", k, LAYER_WIDTH)) for k in range(LAYERS)]
    vectors = rows.select("vec_id", *(p.alias(f"l{k}") for k, p in enumerate(parts)))
    a = vectors.select(F.col("vec_id").alias("query_id"), *(F.col(f"l{k}").alias(f"a{k}") for k in range(LAYERS)))
    b = vectors.select(F.col("vec_id").alias("ref_id"), *(F.col(f"l{k}").alias(f"b{k}") for k in range(LAYERS)))
    wide = ends.join(a, "query_id").join(b, "ref_id")
    per = F.explode(F.array(*(F.struct(F.lit(k).alias("l"), dot(f"a{k}", f"b{k}").alias("ab"), dot(f"a{k}", f"a{k}").alias("aa"), dot(f"b{k}", f"b{k}").alias("bb")) for k in range(LAYERS)))).alias("p")
    products = wide.select("query_id", "side", per).select("query_id", "side", "p.*")
    cosine = products.join(F.broadcast(_subsets(spark, 2)), "l").groupBy("subset", "query_id", "side").agg((F.sum("ab") / F.sqrt(F.sum("aa") * F.sum("bb"))).alias("c"))
    both = cosine.groupBy("subset", "query_id").agg(F.max(F.when(F.col("side") == "near", F.col("c"))).alias("cn"), F.max(F.when(F.col("side") == "far", F.col("c"))).alias("cf"))
    joined = both.join(edges, "query_id").crossJoin(F.broadcast(scale))
    dn, df = F.col("cn") - F.col("near_cosine"), F.col("cf") - F.col("far_cosine")
    miss = F.greatest(F.lit(0.0), F.col("near_cosine") - F.col("far_cosine") - F.col("cn") + F.col("cf"))
    score = F.sum(F.col("weight") * (dn * dn + df * df)) / (2 * F.count("*")) / F.max("scale") + F.avg(F.col("weight") * miss * miss) / F.max("scale")
    return joined.groupBy("subset").agg(r(score).alias("score"))


@register(f"WITH {PATCH}, {LAYER} SELECT vec_id, layer::INT AS layer, round(vec[1], 6) AS first, round(list_sum(vec), 6) AS total FROM layer_vec")
def layer_l2_vectors(spark, sf_dir):
    return layer_vectors(patches(spark, sf_dir)).select("vec_id", "layer", r(F.get("vec", F.lit(0))).alias("first"), r(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@register(f"WITH {PATCH} SELECT image_id, l::INT AS layer, round(sqrt(sum(m * m)), 6) AS pooled_norm FROM (SELECT image_id, j // 16 AS l, j, avg(x) AS m FROM (SELECT image_id, unnest(v) AS x, unnest(range(64)) AS j FROM patch) GROUP BY ALL) GROUP BY image_id, l")
def pooled_layer_norms(spark, sf_dir):
    means = coordinates(patches(spark, sf_dir)).groupBy("image_id", "j").agg(F.avg("x").alias("m"))
    return means.groupBy("image_id", F.expr("j div 16").cast("int").alias("layer")).agg(r(F.sqrt(F.sum(F.col("m") * F.col("m")))).alias("pooled_norm"))


@register(f"WITH {PATCH}, s AS (SELECT vec_id, [v[2] * sqrt(0.5), v[5] * sqrt(0.3), v[33] * sqrt(0.2)] AS s FROM patch) SELECT vec_id, round(s[1] / greatest(sqrt(list_dot_product(s, s)), 1e-12), 6) AS a, round(s[2] / greatest(sqrt(list_dot_product(s, s)), 1e-12), 6) AS b, round(s[3] / greatest(sqrt(list_dot_product(s, s)), 1e-12), 6) AS c FROM s")
def weighted_support_projection(spark, sf_dir):
    s = l2_normalized(take("v", [1, 4, 32], [0.5**0.5, 0.3**0.5, 0.2**0.5]))
    return patches(spark, sf_dir).select("vec_id", s.alias("s")).select("vec_id", *(r(F.get("s", F.lit(k))).alias(n) for k, n in enumerate("abc")))


# --- objective values as pair tables

_MATCH = f"""WITH {PATCH}, st AS (SELECT *, [v[1] * sqrt(0.4), v[17] * sqrt(0.3), v[33] * sqrt(0.2), v[49] * sqrt(0.1)] AS s FROM patch),
p AS (SELECT q.vec_id AS query_id, m.vec_id AS ref_id, list_dot_product(q.v, m.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(m.v, m.v))) AS t,
    list_dot_product(q.s, m.s) / (sqrt(list_dot_product(q.s, q.s)) * sqrt(list_dot_product(m.s, m.s))) AS c FROM st q JOIN st m ON q.image_id <> m.image_id WHERE q.role = 'holdout' AND q.y = 0 AND m.role = 'fit' AND m.y = 0),
z AS (SELECT *, t / 0.1 AS zt, c / 0.1 AS zc, max(t / 0.1) OVER w AS mt, max(c / 0.1) OVER w AS mc FROM p WINDOW w AS (PARTITION BY query_id)),
l AS (SELECT query_id, count(*) AS n, max(t) AS bt, max(c) AS bc, max(mt) + ln(sum(exp(zt - mt))) AS lt, max(mc) + ln(sum(exp(zc - mc))) AS lc FROM z GROUP BY query_id),
k AS (SELECT query_id, max(n) AS n, max(bt) AS bt, max(bc) AS bc, sum(exp(zt - lt) * (zt - lt)) AS ent, sum(exp(zt - lt) * (zc - lc)) AS crs FROM z JOIN l USING (query_id) GROUP BY query_id),
d AS (SELECT *, 1 - bt AS dist FROM k), e AS (SELECT *, least(4.0, 1 + dist / greatest(avg(dist) OVER (), 1e-4)) AS raw FROM d), f AS (SELECT *, raw / avg(raw) OVER () AS w FROM e)"""


_SUPPORT, _WEIGHTS = (0, 16, 32, 48), (0.4, 0.3, 0.2, 0.1)


def _matching(spark, sf_dir):
    rows = patches(spark, sf_dir)
    return losses.matching_terms(normal(rows, "holdout"), normal(rows, "fit"), _SUPPORT, _WEIGHTS, 0.1)


@register(
    f"""{_MATCH} SELECT round(avg(w * (ent - crs)) / greatest(avg(w * (ln(n) + ent)), 1e-6), 6) AS divergence, round(avg(w * (bc - bt) * (bc - bt)) / greatest(avg(w * dist * dist), 1e-4), 6) AS score FROM f"""
)
def matching_loss_value(spark, sf_dir):
    k = _matching(spark, sf_dir)
    f = k.join(statistics.query_weights(k.select("query_id", (1 - F.col("best_teacher")).alias("distance"))), "query_id")
    w, dist = F.col("weight"), 1 - F.col("best_teacher")
    off = F.col("best_student") - F.col("best_teacher")
    return f.agg(
        r(F.avg(w * (F.col("entropy") - F.col("cross"))) / F.greatest(F.avg(w * (F.log("n") + F.col("entropy"))), F.lit(1e-6))).alias("divergence"),
        r(F.avg(w * off * off) / F.greatest(F.avg(w * dist * dist), F.lit(1e-4))).alias("score"),
    )


@register(f"{_MATCH} SELECT query_id, round(ent - crs, 6) AS divergence, round(bt - bc, 6) AS regret FROM f")
def candidate_query_losses(spark, sf_dir):
    return _matching(spark, sf_dir).select("query_id", r(F.col("entropy") - F.col("cross")).alias("divergence"), r(F.col("best_teacher") - F.col("best_student")).alias("regret"))


@register(
    f"""{_MATCH}, pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, ref_id) AS place FROM z), x AS (
  SELECT query_id, max(mc) + ln(sum(exp(zc - mc))) AS la, max(mc) + ln(sum(CASE WHEN place <= 8 THEN exp(zc - mc) * (CASE WHEN place <= 4 THEN 1.0 ELSE 0.5 END) ELSE 0 END)) AS lg FROM pos GROUP BY query_id)
SELECT round(avg(la - lg), 6) AS loss FROM x"""
)
def relation_loss_value(spark, sf_dir):
    rows = patches(spark, sf_dir)
    terms = losses.relation_terms(normal(rows, "holdout"), normal(rows, "fit"), _SUPPORT, _WEIGHTS, 0.1, 4, 8)
    return terms.agg(r(F.avg("loss")).alias("loss"))


@register(
    f"WITH {PATCH}, {_PAIRS}, b AS (SELECT query_id, max(c) AS best FROM pairs GROUP BY query_id) SELECT query_id, round(max(best), 6) AS best, count(*) AS near_ties FROM pairs JOIN b USING (query_id) WHERE best - c <= 64 * 2.220446049250313e-16 * (1 + abs(best)) GROUP BY query_id"
)
def near_tie_counts(spark, sf_dir):
    rows = patches(spark, sf_dir)
    return losses.near_ties(normal(rows, "holdout"), normal(rows, "fit")).select("query_id", r("best").alias("best"), "near_ties")


@register(
    f"""{_EDGES}, moved AS (SELECT a.j, avg(w * ((a.x - n.x) * (a.x - n.x) + (a.x - f.x) * (a.x - f.x)) / 2) AS leverage FROM ww JOIN coord a ON a.vec_id = query_id JOIN coord n ON n.vec_id = near AND n.j = a.j JOIN coord f ON f.vec_id = far AND f.j = a.j GROUP BY a.j)
SELECT j::INT AS j, round(leverage, 9) AS leverage FROM moved""".replace(LAYER + ",", LAYER + ", " + COORD + ",", 1)
)
def leverage_ranking(spark, sf_dir):
    rows = patches(spark, sf_dir)
    edges = _weighted_edges(rows)
    return statistics.edge_leverage(rows, edges).select("j", r("leverage", 9).alias("leverage"))


def _weighted_edges(rows: DataFrame) -> DataFrame:
    edges = neighbours.near_far(normal(rows, "holdout"), normal(rows, "fit"), 8)
    return edges.join(statistics.query_weights(edges.select("query_id", (1 - F.col("near_cosine")).alias("distance"))), "query_id")


@register(f"{_EDGES} SELECT round(sum(w * ((cn - tn) * (cn - tn) + (cf - tf) * (cf - tf))) / (2 * count(*)) / max(scale), 6) AS representation, round(avg(w * greatest(0, tn - tf - cn + cf) * greatest(0, tn - tf - cn + cf)) / max(scale), 6) AS rank FROM wide JOIN ww USING (query_id), scale WHERE subset = 5")
def local_loss_value(spark, sf_dir):
    """The two terms of the local loss for layers 0 and 2: the teacher sees raw columns, the student unit layers."""
    import numpy as np

    rows = patches(spark, sf_dir)
    edges = _weighted_edges(rows)
    sq = lambda c: (1 - F.col(c)) * (1 - F.col(c))
    scale = edges.agg(F.greatest((F.sum(sq("near_cosine")) + F.sum(sq("far_cosine"))) / (2 * F.count("*")), F.lit(1e-4))).first()[0]
    layers, width = LAYERS, LAYER_WIDTH

    def unit(x):
        parts = x.reshape(len(x), layers, width)
        return (parts / np.maximum(np.linalg.norm(parts, axis=2), 1e-12)[:, :, None]).reshape(len(x), -1)

    active = np.concatenate([np.arange(16), np.arange(32, 48)])
    terms = losses.local_terms(edges, rows, active, np.full(32, 1 / 32), scale, unit)
    return terms.select(r("representation").alias("representation"), r("rank").alias("rank"))


@register(
    f"""WITH {PATCH}, st AS (SELECT vec_id, v, [v[1] * sqrt(0.4), v[17] * sqrt(0.3), v[33] * sqrt(0.2), v[49] * sqrt(0.1)] AS s FROM patch WHERE role = 'holdout' AND y = 0),
p AS (SELECT list_dot_product(q.v, m.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(m.v, m.v))) AS t, list_dot_product(q.s, m.s) / (sqrt(list_dot_product(q.s, q.s)) * sqrt(list_dot_product(m.s, m.s))) AS c FROM st q, st m)
SELECT round(0.5 * sum((c - t) * (c - t)) / sum(t * t), 6) AS loss FROM p"""
)
def cosine_gram_loss_value(spark, sf_dir):
    value = losses.gram_loss(normal(patches(spark, sf_dir), "holdout"), _SUPPORT, _WEIGHTS)
    return spark.createDataFrame([(value,)], "loss double").select(r("loss").alias("loss"))


_GRAM_H = f"WITH {PATCH}, {COORD}, g AS (SELECT a.j AS i, b.j AS j, avg(a.x * b.x) AS g FROM coord a JOIN coord b ON a.vec_id = b.vec_id WHERE a.role = 'fit' AND a.y = 0 GROUP BY a.j, b.j), h AS (SELECT i, j, g * g / (SELECT sum(g * g) FROM g) AS h FROM g)"


@register(f"{_GRAM_H} SELECT round(0.5 * sum((1 - (i % 4 = 0)::INT * 0.5) * (1 - (j % 4 = 0)::INT * 0.5) * h), 8) AS value, round(sqrt(sum((1 - (i % 4 = 0)::INT * 0.5) * (1 - (j % 4 = 0)::INT * 0.5) * h)), 8) AS error FROM h")
def quadratic_loss_value(spark, sf_dir):
    import numpy as np

    from fathom.operators.losses import QuadraticObjective

    h = statistics.squared_gram(statistics.gram(normal(patches(spark, sf_dir), "fit")))
    quadratic = QuadraticObjective(h, np.zeros((64, 0)), 0.0)
    w = np.where(np.arange(64) % 4 == 0, 0.5, 0.0)
    return spark.createDataFrame([(quadratic(w)[0], quadratic.error(w))], "value double, error double").select(r("value", 8).alias("value"), r("error", 8).alias("error"))


@register(f"{_GRAM_H}, s AS (SELECT i, sum(h) AS share FROM h GROUP BY i), k AS (SELECT row_number() OVER (ORDER BY share DESC, i) AS place, sum(share) OVER (ORDER BY share DESC, i ROWS UNBOUNDED PRECEDING) AS covered, sum(share) OVER () AS whole FROM s) SELECT min(place)::INT AS needed FROM k WHERE covered >= 0.9 * whole")
def budget_geometry_bound(spark, sf_dir):
    share = statistics.squared_gram(statistics.gram(normal(patches(spark, sf_dir), "fit"))).sum(1)
    return statistics.budget_bound(spark.createDataFrame([(j, float(s)) for j, s in enumerate(share)], "j int, share double"), 0.1).select(F.col("needed").cast("int").alias("needed"))


# --- choice rules


def _path(spark, sf_dir):
    """A candidate table made of parts: retained from size, error from price."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lam"), F.col("p_size").cast("int").alias("retained"), r(F.col("p_retailprice") / 2000, 6).cast("double").alias("error"))


_PATH = "path AS (SELECT p_partkey AS lam, p_size::INT AS retained, round(p_retailprice / 2000, 6)::DOUBLE AS error FROM part)"


@register(f"WITH {_PATH} SELECT lam, retained, error, error <= 0.6 AS feasible FROM path ORDER BY (error > 0.6), CASE WHEN error <= 0.6 THEN retained ELSE 0 END, error, lam LIMIT 1")
def lambda_path_select(spark, sf_dir):
    return selection.path_choice(_path(spark, sf_dir), 0.6)


@register(f"WITH {_PATH} SELECT count(*) AS candidates, sum((error <= 0.6)::INT)::BIGINT AS feasible, min(error) AS least_error, min(CASE WHEN error <= 0.6 THEN retained END) AS least_feasible_size FROM path")
def feasibility_diagnostics(spark, sf_dir):
    return selection.feasibility_counts(_path(spark, sf_dir).withColumnRenamed("retained", "size"), 0.6)


@register(f"WITH {_PATH} SELECT lam AS id, retained::DOUBLE AS objective, error FROM path ORDER BY (error > 0.6), CASE WHEN error <= 0.6 THEN retained ELSE error END, CASE WHEN error <= 0.6 THEN error ELSE retained END, lam LIMIT 1")
def fixed_budget_select(spark, sf_dir):
    return selection.fixed_budget_choice(_path(spark, sf_dir).select(F.col("lam").alias("id"), F.col("retained").cast("double").alias("objective"), "error"), 0.6)


@register(
    "SELECT l_suppkey, l_partkey AS j, w FROM (SELECT l_suppkey, l_partkey, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_partkey) <= 5"
)
def top_weight_budget(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").cast("double").alias("w"))
    return selection.top_weights(w, ["l_suppkey"], 5)


_CAND = """cand AS (SELECT c_nationkey AS id, round(avg(c_acctbal), 4)::DOUBLE AS mean, round(stddev_pop(c_acctbal), 4) AS mse, round(quantile_cont(c_acctbal, 0.9), 4)::DOUBLE AS cvar FROM customer GROUP BY c_nationkey)"""


@register(
    f"""WITH {_CAND}, b AS (SELECT * FROM cand WHERE id = 7), e AS (SELECT cand.*, b.cvar AS bc FROM cand, b WHERE cand.mean <= b.mean + 1.0 * 500 AND cand.mse <= b.mse AND cand.cvar <= b.cvar)
SELECT CASE WHEN arg_min(cvar, (cvar, mean, id)) < max(bc) THEN arg_min(id, (cvar, mean, id)) ELSE 7 END AS winner, count(*) AS n_eligible FROM e"""
)
def guarded_candidate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(
        F.round(F.avg("c_acctbal"), 4).cast("double").alias("mean"), F.round(F.stddev_pop("c_acctbal"), 4).alias("mse"), F.round(F.percentile("c_acctbal", F.lit(0.9)), 4).cast("double").alias("cvar")
    )
    return selection.guarded_choice(c, F.lit(7), F.lit(500.0), 1.0)


_POOL = "pool AS (SELECT o_orderkey AS id, list_sort([o_custkey % 7, 7 + o_custkey % 5]) AS active, o_totalprice::DOUBLE AS loss FROM orders)"


@register(f"WITH {_POOL}, b AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY active ORDER BY loss, id) = 1) SELECT id, array_to_string(active, ';') AS active, loss FROM b ORDER BY loss, id LIMIT 20")
def best_support_dedup(spark, sf_dir):
    pool = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.sort_array(F.array(F.col("o_custkey") % 7, 7 + F.col("o_custkey") % 5)).alias("active"), F.col("o_totalprice").cast("double").alias("loss"))
    return selection.best_supports(pool, 20).select("id", F.array_join("active", ";").alias("active"), "loss")


@register("WITH pool AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE AS a, (o_custkey % 1000)::DOUBLE AS b FROM orders) SELECT id, a + b AS score FROM pool ORDER BY a + b, id LIMIT 1")
def frozen_pool_choice(spark, sf_dir):
    pool = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("holdout_loss"), (F.col("o_custkey") % 1000).cast("double").alias("training_nuisance"))
    return selection.frozen_choice(pool)


@register("WITH t AS (SELECT user_id AS run, event_id AS step, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) SELECT run, count(*) AS violations FROM t WHERE previous IS NOT NULL AND NOT value < previous GROUP BY run")
def descent_violations(spark, sf_dir):
    trace = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value")
    return selection.descent_violations(trace).groupBy("run").agg(F.count("*").alias("violations"))


# --- column rankings

_GRAPH = f"""WITH {PATCH}, {COORD}, {_PAIRS.replace("q.role = 'holdout'", "q.role = 'fit'")}, edges AS (SELECT query_id, ref_id, 1.0 / rank AS weight FROM ranked WHERE rank <= 3)"""


@register(
    f"""{_GRAPH}, m AS (SELECT a.j, sum(weight * (a.x - b.x) * (a.x - b.x)) / sum(weight) AS moved FROM edges JOIN coord a ON a.vec_id = query_id JOIN coord b ON b.vec_id = ref_id AND b.j = a.j GROUP BY a.j),
s AS (SELECT j, var_pop(x) AS var FROM coord WHERE role = 'fit' AND y = 0 GROUP BY j) SELECT j::INT AS j, round(CASE WHEN var > 1e-12 THEN moved / var ELSE 'infinity'::DOUBLE END, 6) AS score FROM m JOIN s USING (j)"""
)
def laplacian_score(spark, sf_dir):
    rows = normal(patches(spark, sf_dir), "fit")
    edges = neighbours.nearest(rows, rows, 3, other_group=True).select("query_id", "ref_id", (1 / F.col("rank")).alias("weight"))
    return statistics.laplacian_scores(rows, edges).select("j", r("score").alias("score"))


@register(
    f"""WITH {PATCH}, {COORD}, o AS (SELECT *, dense_rank() OVER (ORDER BY image_id) % 2 AS half FROM coord WHERE role = 'fit' AND y = 0), v AS (SELECT j, var_pop(x) FILTER (half = 0) AS a, var_pop(x) FILTER (half = 1) AS b FROM o GROUP BY j)
SELECT j::INT AS j, round(least(a, b) / greatest(greatest(a, b), 1e-12), 6) AS ratio FROM v"""
)
def split_repeatability(spark, sf_dir):
    return statistics.split_repeatability(normal(patches(spark, sf_dir), "fit")).select("j", r("ratio").alias("ratio"))


@register(
    f"""WITH {PATCH}, {COORD}, {PERTURBED}, e AS (SELECT j, avg(x * x) AS energy FROM coord WHERE role = 'fit' AND y = 0 GROUP BY j),
n AS (SELECT j, avg((x - z) * (x - z)) AS nu FROM (SELECT unnest(v) AS x, unnest(w) AS z, unnest(range(64)) AS j FROM perturbed WHERE role = 'fit' AND y = 0) GROUP BY j) SELECT j::INT AS j, round(energy, 8) AS energy, round(energy / (nu + 1e-6), 4) AS stability FROM e JOIN n USING (j)"""
)
def coordinate_scores(spark, sf_dir):
    rows = normal(patches(spark, sf_dir), "fit")
    return statistics.coordinate_scores(rows, perturbed(rows)).select("j", r("energy", 8).alias("energy"), r("stability", 4).alias("stability"))


@register("WITH k AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, rank() OVER (ORDER BY length(source)) + (count(*) OVER (PARTITION BY length(source)) - 1) / 2.0 AS b FROM documents) SELECT round(corr(a, b), 6) AS rho FROM k")
def rank_correlation(spark, sf_dir):
    return statistics.spearman(table(spark, sf_dir, "documents").withColumn("m", F.length("source")), "n_chars", "m").select(r("rho").alias("rho"))


@register(f"WITH {PATCH}, {DIST}, w AS (SELECT vec_id AS query_id, least(4.0, 1 + distance / greatest(avg(distance) OVER (), 1e-4)) AS raw FROM dist) SELECT query_id, round(raw / avg(raw) OVER (), 6) AS weight FROM w")
def teacher_row_weights(spark, sf_dir):
    return statistics.query_weights(_distances(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "distance")).select("query_id", r("weight").alias("weight"))
from fathom.plans import audit_queries, report_queries  # noqa: E402, F401  register more queries
