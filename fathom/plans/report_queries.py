"""Queries of pixel metrics, image arithmetic, catalogues, reports, audits and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import names
from fathom.functions.vectors import dot, norm
from fathom.operators import catalogue, metrics, provenance, reports, sampling
from fathom.operators.views import COORD, GRID, PATCH, coordinates, normal, patches, table
from fathom.plans.queries import r, register

# --- pixels: the 64 components as an 8 x 8 grid, score 4 |x|, mask x > 0.25

_PIX = f"WITH {PATCH}, {COORD}, pix AS (SELECT vec_id, j, j // 8 AS r, j % 8 AS c, least(4 * abs(x), 2 - 1e-7) AS s, (x > 0.2)::INT AS y FROM coord)"


def _pixels(spark, sf_dir) -> DataFrame:
    x = coordinates(patches(spark, sf_dir))
    return x.select(F.col("vec_id").alias("image_id"), "j", F.expr(f"j div {GRID}").cast("int").alias("r"), (F.col("j") % GRID).alias("c"), F.least(4 * F.abs("x"), F.lit(2 - 1e-7)).alias("s"), (F.col("x") > 0.2).cast("int").alias("y"))


@register(f"{_PIX} SELECT floor(s * 512)::INT AS bin, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM pix GROUP BY 1")
def pixel_histogram(spark, sf_dir):
    return metrics.pixel_histogram(_pixels(spark, sf_dir))


@register(
    f"""{_PIX}, h AS (SELECT floor(s * 512)::INT AS bin, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM pix GROUP BY 1),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM h WINDOW w AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(neg * (tp - 0.5 * pos)) / max(p * n), 8) AS pixel_auroc, round(sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / max(p), 8) AS pixel_ap FROM k"""
)
def pixel_metrics(spark, sf_dir):
    return metrics.histogram_metrics(metrics.pixel_histogram(_pixels(spark, sf_dir))).select(r("pixel_auroc", 8).alias("pixel_auroc"), r("pixel_ap", 8).alias("pixel_ap"))


_REGION = f"""WITH RECURSIVE {PATCH}, {COORD}, pix AS (SELECT vec_id, j, j // 8 AS r, j % 8 AS c, least(4 * abs(x), 2 - 1e-7) AS s, x > 0.2 AS y FROM coord),
reach AS (SELECT vec_id, j AS j, j AS root, 0 AS step FROM pix WHERE y UNION
  SELECT a.vec_id, b.j, a.root, 0 FROM reach a JOIN pix p ON p.vec_id = a.vec_id AND p.j = a.j JOIN pix b ON b.vec_id = a.vec_id AND b.y AND abs(p.r - b.r) + abs(p.c - b.c) = 1),
lab AS (SELECT vec_id, j, min(root) AS root FROM reach GROUP BY vec_id, j)"""


def _regions(spark, sf_dir) -> DataFrame:
    """``image_id, j, region, s``: region 0 is background, others are numbered by their first pixel + 1."""
    import numpy as np
    import pandas as pd

    grids = _pixels(spark, sf_dir).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("j", "y", "s"))).alias("cells"))  # 64 cells an image

    def run(frames):
        for frame in frames:
            for image, cells in zip(frame["image_id"], frame["cells"], strict=True):
                y = np.array([c["y"] for c in cells]).reshape(GRID, GRID)
                number, _ = metrics.label_regions(y == 1)
                flat = number.ravel()
                first = {k: int(np.flatnonzero(flat == k)[0]) + 1 for k in np.unique(flat) if k}
                yield pd.DataFrame({"image_id": image, "j": range(GRID * GRID), "region": [first.get(k, 0) for k in flat], "s": [c["s"] for c in cells]})

    return grids.mapInPandas(run, "image_id long, j int, region int, s double")


@register(f"{_REGION} SELECT vec_id AS image_id, j::INT AS j, (root + 1)::INT AS region FROM lab")
def mask_regions(spark, sf_dir):
    return _regions(spark, sf_dir).filter("region > 0").select("image_id", "j", "region")


_PRO = f"""{_REGION}, full_ AS (SELECT p.vec_id, p.j, coalesce(root + 1, 0) AS region, s FROM pix p LEFT JOIN lab USING (vec_id, j)),
thr AS (SELECT k AS step, 2 - k * (2.0::DOUBLE / 99) AS t FROM (SELECT unnest(range(100)) AS k)), sz AS (SELECT vec_id, region, count(*) AS n FROM full_ GROUP BY ALL),
hit AS (SELECT step, vec_id, region, count(*) AS c FROM full_ JOIN thr ON ceil((2 - s) * (99 / 2.0::DOUBLE) - 1e-9) <= step GROUP BY ALL),
cur AS (SELECT step, sum(CASE WHEN region = 0 THEN c ELSE 0 END)::DOUBLE / (SELECT sum(n) FROM sz WHERE region = 0) AS fpr, sum(CASE WHEN region > 0 THEN c / n::DOUBLE ELSE 0 END) / (SELECT count(*) FROM sz WHERE region > 0) AS pro
  FROM hit JOIN sz USING (vec_id, region) GROUP BY step), whole AS (SELECT thr.step, coalesce(fpr, 0) AS fpr, coalesce(pro, 0) AS pro FROM thr LEFT JOIN cur USING (step))"""


@register(f"{_PRO} SELECT step::INT AS step, round(fpr, 6) AS fpr, round(pro, 6) AS pro FROM whole")
def pro_thresholds(spark, sf_dir):
    return metrics.overlap_curve(_regions(spark, sf_dir)).select("step", r("fpr").alias("fpr"), r("pro").alias("pro"))


@register(
    f"""{_PRO}, b AS (SELECT round(fpr, 12) AS fpr, max(pro) AS pro FROM whole GROUP BY 1), k AS (SELECT *, lag(fpr) OVER (ORDER BY fpr) AS x0, lag(pro) OVER (ORDER BY fpr) AS y0 FROM b)
SELECT round(sum(CASE WHEN x0 < 0.3 THEN (least(fpr, 0.3) - x0) * (y0 + y0 + (pro - y0) * (least(fpr, 0.3) - x0) / (fpr - x0)) / 2 END) / 0.3, 6) AS aupro FROM k"""
)
def aupro(spark, sf_dir):
    curve = metrics.overlap_curve(_regions(spark, sf_dir)).withColumn("fpr", F.round("fpr", 12))
    return metrics.area_under_overlap(curve).select(r("aupro").alias("aupro"))


_UP = "CASE WHEN (k + 0.5) / 2 - 0.5 < 0 THEN 0 ELSE (k + 0.5) / 2 - 0.5 END"


@register(
    f"""{_PIX}, w AS (SELECT k, floor({_UP})::INT AS lo, least(7, floor({_UP}) + 1)::INT AS hi, {_UP} - floor({_UP}) AS f FROM (SELECT unnest(range(16)) AS k)),
t AS (SELECT k, lo AS i, 1 - f AS a FROM w UNION ALL SELECT k, hi, f FROM w)
SELECT vec_id AS image_id, y.k::INT AS row, x.k::INT AS col, round(sum(y.a * x.a * s), 6) AS s FROM pix JOIN t y ON y.i = r JOIN t x ON x.i = c WHERE vec_id < 50 OR true GROUP BY vec_id, y.k, x.k""".replace(" WHERE vec_id < 50 OR true", "")
)
def bilinear_upsample(spark, sf_dir):
    """Every 8 x 8 map at 16 x 16, as a weighted join with the rows of the resampling matrix."""
    m = metrics.bilinear_matrix(GRID, 2 * GRID)
    w = F.broadcast(spark.createDataFrame([(k, i, float(m[k, i])) for k in range(2 * GRID) for i in range(GRID) if m[k, i]], "k int, i int, a double"))
    p = _pixels(spark, sf_dir).select("image_id", "r", "c", "s")
    rows = p.join(w.select(F.col("i").alias("r"), F.col("k").alias("row"), F.col("a").alias("ya")), "r").join(w.select(F.col("i").alias("c"), F.col("k").alias("col"), F.col("a").alias("xa")), "c")
    return rows.groupBy("image_id", "row", "col").agg(r(F.sum(F.col("ya") * F.col("xa") * F.col("s"))).alias("s"))


_GREY = "grey AS (SELECT event_type AS image, (abs(floor(value))::BIGINT % 256)::INT AS v FROM events WHERE value IS NOT NULL)"


@register(
    f"""WITH {_GREY}, h AS (SELECT image, v, count(*) AS n FROM grey WHERE v > 0 GROUP BY ALL), c AS (SELECT image, v, floor(round(255 * (sum(n) OVER (PARTITION BY image ORDER BY v))::DOUBLE / sum(n) OVER (PARTITION BY image), 9)) AS g FROM h)
SELECT image, v, (CASE WHEN g > 0 AND g < 150 THEN floor(round(g / 150 * 120 + 30, 9)) ELSE g END)::INT AS mapped FROM c"""
)
def hist_equalize_lut(spark, sf_dir):
    grey = table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_type").alias("image"), (F.abs(F.floor("value")).cast("long") % 256).cast("int").alias("v"))
    h = grey.filter("v > 0").groupBy("image", "v").agg(F.count("*").alias("n"))
    by = Window.partitionBy("image")
    g = F.floor(F.round(255 * F.sum("n").over(by.orderBy("v")).cast("double") / F.sum("n").over(by), 9))
    mapped = h.select("image", "v", g.alias("g"))
    return mapped.select("image", "v", F.when((F.col("g") > 0) & (F.col("g") < 150), F.floor(F.round(F.col("g") / 150 * 120 + 30, 9))).otherwise(F.col("g")).cast("int").alias("mapped"))


@register(
    "WITH p AS (SELECT event_type, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY event_type) SELECT event_id, floor(round(least(1.0, greatest(0.0, (value - lo) / (hi - lo))) * 255, 9))::INT AS grey FROM events JOIN p USING (event_type)"
)
def percentile_stretch(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    p = e.groupBy("event_type").agg(F.percentile("value", F.lit(0.005)).alias("lo"), F.percentile("value", F.lit(0.995)).alias("hi"))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return e.join(F.broadcast(p), "event_type").select("event_id", F.floor(F.round(part * 255, 9)).cast("int").alias("grey"))


# --- metric tables: nations as datasets, priorities as methods, ship modes as seeds

_LONG = """metric AS (SELECT n_name AS dataset, 'm' || (1 + o_orderkey % 3) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_seed' || (o_custkey % 5) END AS method, avg(o_totalprice / 600000)::DOUBLE AS auroc, avg(c_acctbal / 9973)::DOUBLE AS ap
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
_FAM = f"""{_LONG}, fam AS (SELECT dataset, regexp_replace(method, '_seed\\d+$', '') AS family, count(*) AS runs, avg(auroc) AS auroc_mean, coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(auroc) END, 0) AS auroc_sd, avg(ap) AS ap_mean, coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(ap) END, 0) AS ap_sd FROM metric GROUP BY ALL)"""


def _metric(spark, sf_dir) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey") % 3
    method = F.concat(F.lit("m"), (1 + k).cast("string"), F.when(k == 0, "").otherwise(F.concat(F.lit("_seed"), (F.col("o_custkey") % 5).cast("string"))))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("dataset"), method.alias("method")).agg(F.avg(F.col("o_totalprice") / 600000).cast("double").alias("auroc"), F.avg(F.col("c_acctbal") / 9973).cast("double").alias("ap"))


def _families(spark, sf_dir) -> DataFrame:
    return reports.family_summary(_metric(spark, sf_dir), ["dataset"], ["auroc", "ap"])


@register(f"WITH {_FAM} SELECT dataset, family, runs, round(auroc_mean, 6) AS auroc_mean, round(auroc_sd, 6) AS auroc_sd, round(ap_mean, 6) AS ap_mean, round(ap_sd, 6) AS ap_sd FROM fam")
def family_summary(spark, sf_dir):
    return _families(spark, sf_dir).select("dataset", "family", "runs", *(r(c).alias(c) for c in ("auroc_mean", "auroc_sd", "ap_mean", "ap_sd")))


@register(f"WITH {_FAM} SELECT a.dataset, a.family, round(b.auroc_mean - a.auroc_mean, 6) AS delta FROM fam a JOIN fam b USING (dataset) WHERE b.family = 'm1' AND a.family <> 'm1'")
def paired_delta(spark, sf_dir):
    return reports.paired_deltas(_families(spark, sf_dir), ["dataset"], "auroc_mean", "m1").select("dataset", "family", r("delta").alias("delta"))


@register(f"WITH {_FAM} SELECT family, round(avg(auroc_mean), 6) AS macro, count(*) AS datasets FROM fam GROUP BY family")
def macro_average(spark, sf_dir):
    return reports.macro_average(_families(spark, sf_dir), "auroc_mean").select("family", r("macro").alias("macro"), "datasets")


@register(f"WITH {_FAM} SELECT min((m >= 0.005)::INT) AS passes, count(*) AS comparisons FROM (SELECT a.family, avg(b.auroc_mean - a.auroc_mean) AS m FROM fam a JOIN fam b USING (dataset) WHERE b.family = 'm1' AND a.family <> 'm1' GROUP BY a.family)")
def directional_gate(spark, sf_dir):
    return reports.directional_gate(reports.paired_deltas(_families(spark, sf_dir), ["dataset"], "auroc_mean", "m1"), ["family"])


@register(f"WITH {_LONG} SELECT dataset, regexp_replace(method, '_seed\\d+$', '') AS family, round(avg(auroc), 6) AS mean, round(coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(auroc) END, 0), 6) AS sd, count(auroc) AS n FROM metric WHERE method LIKE 'm2%' GROUP BY ALL")
def random_within_fit_sd(spark, sf_dir):
    return reports.within_fit_spread(_metric(spark, sf_dir), ["dataset"], "auroc", "m2").select("dataset", "family", r("mean").alias("mean"), r("sd").alias("sd"), "n")


@register("SELECT lang, sum((toxic = 0)::INT)::BIGINT AS normal, sum((toxic = 1)::INT)::BIGINT AS abnormal, round(avg(toxic), 6) AS prevalence FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY lang")
def prevalence(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("toxic is not null").withColumn("y", F.col("toxic"))
    return reports.prevalence(labelled, ["lang"]).select("lang", "normal", "abnormal", r("prevalence").alias("prevalence"))


@register("WITH m AS (SELECT s_name AS method, [1 + s_suppkey % 4, 1 + (s_suppkey + 1) % 4] AS chosen, [s_acctbal, s_acctbal / 2, s_acctbal / 4, s_acctbal / 8] AS scores FROM supplier) SELECT method, l::INT AS layer, list_contains(chosen, l)::INT AS selected, round(scores[l], 6)::DOUBLE AS score FROM m, (SELECT unnest(range(1, 5)) AS l)")
def layer_rows_explode(spark, sf_dir):
    k = F.col("s_suppkey")
    bal = F.col("s_acctbal").cast("double")
    m = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("method"), F.array((1 + k % 4).cast("int"), (1 + (k + 1) % 4).cast("int")).alias("chosen"), F.array(bal, bal / 2, bal / 4, bal / 8).alias("scores"))
    return reports.layer_rows(m, 4).select("method", "layer", "selected", r("score").alias("score"))


@register(f"WITH {_FAM} SELECT dataset, round(max(CASE WHEN family = 'm1' THEN auroc_mean END), 6) AS m1, round(max(CASE WHEN family = 'm2' THEN auroc_mean END), 6) AS m2, round(max(CASE WHEN family = 'm3' THEN auroc_mean END), 6) AS m3 FROM fam GROUP BY dataset")
def family_pivot(spark, sf_dir):
    wide = reports.as_pivot(_families(spark, sf_dir), "dataset", "family", "auroc_mean", ["m1", "m2", "m3"])
    return wide.select("dataset", *(r(c).alias(c) for c in ("m1", "m2", "m3")))


@register(f"WITH {_LONG} SELECT dataset, method, printf('%.2f ± %.2f', auroc * 100, ap * 100) AS shown FROM metric")
def formatted_scores(spark, sf_dir):
    return _metric(spark, sf_dir).select("dataset", "method", reports.formatted(F.col("auroc"), F.col("ap")).alias("shown"))


@register(
    f"""WITH {_LONG}, every_ AS (SELECT dataset, method FROM (SELECT DISTINCT dataset FROM metric), (SELECT DISTINCT method FROM metric))
SELECT (SELECT count(*) FROM (SELECT dataset, method FROM metric GROUP BY ALL HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM metric WHERE auroc < 0 OR auroc > 1 OR ap < 0 OR ap > 1) AS out_of_range, (SELECT count(*) FROM every_ ANTI JOIN metric USING (dataset, method)) AS missing"""
)
def coverage_violations(spark, sf_dir):
    m = _metric(spark, sf_dir)
    parts = [
        reports.not_unique(m, ["dataset", "method"]).agg(F.count("*").alias("repeated")),
        reports.out_of_range(m, ["auroc", "ap"]).agg(F.count("*").alias("out_of_range")),
        reports.missing_combinations(m, "dataset", "method").agg(F.count("*").alias("missing")),
    ]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@register(
    f"""WITH {_LONG}, b AS (SELECT dataset, method, CASE WHEN dataset < 'NATION_12' THEN auroc + 0.001 ELSE auroc END AS auroc FROM metric WHERE dataset <> 'NATION_3')
SELECT coalesce(a.dataset || '/' || a.method, b.dataset || '/' || b.method) AS key FROM metric a FULL JOIN b USING (dataset, method) WHERE NOT coalesce(abs(a.auroc - b.auroc) <= 1e-12, false)"""
)
def anchor_differences(spark, sf_dir):
    m = _metric(spark, sf_dir).select(F.concat_ws("/", "dataset", "method").alias("key"), "dataset", "auroc")
    changed = m.filter("dataset <> 'NATION_3'").withColumn("auroc", F.when(F.col("dataset") < "NATION_12", F.col("auroc") + 0.001).otherwise(F.col("auroc")))
    return reports.anchor_differences(m, changed, "key", ["auroc"], 1e-12).select("key")


# --- catalogues: page addresses as paths

_PATHS = "p AS (SELECT page_id, regexp_replace(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '#.*$', '') AS path FROM pages)"


def _paths(spark, sf_dir) -> DataFrame:
    bare = F.regexp_replace(F.substring_index(F.regexp_replace("url", "^[a-z]+://", ""), "?", 1), "#.*$", "")
    return table(spark, sf_dir, "pages").select("page_id", bare.alias("path"))


@register(
    f"""WITH {_PATHS} SELECT page_id, list_last(string_split(path, '/')) AS file, CASE WHEN len(string_split(path, '/')) > 1 THEN list_extract(string_split(path, '/'), -2) ELSE '' END AS parent, regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '') AS stem,
  CASE WHEN replace(replace(lower(path), '-', ''), '_', '') LIKE '%spam%' THEN 'bad' WHEN replace(replace(lower(path), '-', ''), '_', '') LIKE '%casino%' THEN 'bad' WHEN replace(replace(lower(path), '-', ''), '_', '') LIKE '%blog%' THEN 'blog' END AS alias FROM p"""
)
def path_parts(spark, sf_dir):
    p = F.col("path")
    aliases = (("spam", "bad"), ("casino", "bad"), ("blog", "blog"))
    return _paths(spark, sf_dir).select("page_id", names.file_name(p).alias("file"), names.parent(p).alias("parent"), names.stem(p).alias("stem"), names.dataset_of(p, aliases).alias("alias"))


@register(
    f"""WITH {_PATHS}, i AS (SELECT page_id, path, lower(regexp_replace(path, '^[^/]*/', '')) AS k1, lower(list_last(string_split(path, '/'))) AS k2 FROM p WHERE page_id % 2 = 0),
m AS (SELECT page_id, path, lower(regexp_replace(path, '^[^/]*/', '')) AS k1, lower(list_last(string_split(path, '/'))) AS k2 FROM p WHERE page_id % 2 = 1),
a AS (SELECT k1, min(path) AS m1, count(*) AS n1 FROM m GROUP BY k1), b AS (SELECT k2, min(path) AS m2, count(*) AS n2 FROM m GROUP BY k2)
SELECT page_id, coalesce(m1, m2) AS mask_path, coalesce(n1, n2, 0) AS candidates FROM i LEFT JOIN a USING (k1) LEFT JOIN b USING (k2)"""
)
def mask_match_cascade(spark, sf_dir):
    """Even pages find their mask among odd ones: the same path below the host first, then the same file name."""
    p = _paths(spark, sf_dir)
    keys = {"k1": F.lower(F.regexp_replace("path", "^[^/]*/", "")), "k2": F.lower(names.file_name(F.col("path")))}
    images, masks = p.filter("page_id % 2 = 0").withColumns(keys), p.filter("page_id % 2 = 1").withColumns(keys)
    for n, k in enumerate(keys, 1):
        images = images.join(masks.groupBy(k).agg(F.min("path").alias(f"m{n}"), F.count("*").alias(f"n{n}")), k, "left")
    return images.select("page_id", F.coalesce("m1", "m2").alias("mask_path"), F.coalesce("n1", "n2", F.lit(0)).alias("candidates"))


@register("SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= 8 THEN 'valid' ELSE 'test' END AS split FROM customer")
def split_by_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return catalogue.ranked_split(rows, ["c_mktsegment"], ["c_custkey"], 8).select("c_custkey", "split")


@register(
    "WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT c_mktsegment, round_even(n * 149 / (SELECT sum(n) FROM n)::DOUBLE, 0)::BIGINT AS valid FROM n) SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= valid THEN 'valid' ELSE 'test' END AS split FROM customer JOIN s USING (c_mktsegment)"
)
def split_in_proportion(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return catalogue.proportional_split(rows, "c_mktsegment", "c_custkey", 149).select("c_custkey", "split")


@register("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_label_wins(spark, sf_dir):
    return catalogue.last_label(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@register("SELECT split, label, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'valid' ELSE 'test' END AS split, toxic AS label FROM labels) GROUP BY ALL")
def split_counts(spark, sf_dir):
    k = F.col("doc_id") % 5
    rows = table(spark, sf_dir, "labels").select(F.when(k < 3, "train").when(k == 3, "valid").otherwise("test").alias("split"), F.col("toxic").alias("label"))
    return catalogue.split_counts(rows)


# --- sampling and provenance

_HASHED = "md5('17:' || vec_id)"


@register(f"WITH {PATCH} SELECT image_id, vec_id FROM patch WHERE role = 'fit' AND y = 0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {_HASHED}, vec_id) <= 2")
def hashed_patch_sample(spark, sf_dir):
    return sampling.hashed_sample(normal(patches(spark, sf_dir), "fit"), "vec_id", 2, 17, ["image_id"]).select("image_id", "vec_id")


@register(f"WITH {PATCH} SELECT vec_id FROM patch WHERE role = 'fit' AND y = 0 ORDER BY {_HASHED}, vec_id LIMIT 100")
def hashed_memory_sample(spark, sf_dir):
    return sampling.hashed_sample(normal(patches(spark, sf_dir), "fit"), "vec_id", 100, 17).select("vec_id")


@register()
def reservoir_memory(spark, sf_dir):
    """The rows that a seeded reservoir of 64 keeps, joined by their position of arrival."""
    rows = normal(patches(spark, sf_dir), "fit")
    kept = sampling.reservoir_positions(rows.count(), 64, 42)
    slots = spark.createDataFrame([(s, int(p)) for s, p in enumerate(kept)], "slot int, position long")
    placed = metrics.places(rows.select(F.col("vec_id").alias("s"))).select(F.col("s").cast("long").alias("vec_id"), F.col("below").cast("long").alias("position"))
    return placed.join(F.broadcast(slots), "position").select("slot", "vec_id")


@register("SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT doc_id || '|' || source || '|' || n_chars AS line FROM documents)")
def data_fingerprint(spark, sf_dir):
    return provenance.data_fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "source", "n_chars"])


@register("SELECT doc_id, sha256(replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) AS digest FROM documents")
def content_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", provenance.content_digest(F.coalesce("text", F.lit(""))).alias("digest"))


@register(
    """WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS d FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN 'changed' ELSE d END AS d FROM a WHERE doc_id % 100 <> 3)
SELECT coalesce(a.doc_id, b.doc_id) AS key, CASE WHEN b.d IS NULL THEN 'added' WHEN a.d IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM a FULL JOIN b USING (doc_id) WHERE a.d IS DISTINCT FROM b.d"""
)
def manifest_differences(spark, sf_dir):
    now = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    recorded = now.filter("key % 100 <> 3").withColumn("digest", F.when(F.col("key") % 100 == 7, "changed").otherwise(F.col("digest")))
    return provenance.manifest_differences(now, recorded)


@register("SELECT page_id, path NOT LIKE '/%' AND path NOT LIKE '%..%' AS safe FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)")
def safe_members(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.safe_member(F.regexp_replace("url", "^[a-z]+://", "")).alias("safe"))


@register(
    f"WITH {PATCH} SELECT count(*) AS shared FROM (SELECT DISTINCT image_id FROM patch WHERE role = 'fit') JOIN (SELECT DISTINCT image_id FROM patch WHERE role = 'holdout') USING (image_id)"
)
def fit_holdout_overlap(spark, sf_dir):
    rows = patches(spark, sf_dir)
    return reports.overlap(rows.filter("role = 'fit'"), rows.filter("role = 'holdout'"), "image_id").agg(F.count("*").alias("shared"))


@register("WITH v AS (SELECT p_brand, p_size::DOUBLE AS x FROM part), m AS (SELECT max(x) AS m FROM v) SELECT p_brand, round(exp(max(x) - m) * sum(exp(x - m)), 6) AS mass FROM v, m GROUP BY p_brand, m")
def softmax_mass(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("x"))
    m = v.agg(F.max("x").alias("m"))
    return v.crossJoin(F.broadcast(m)).groupBy("p_brand").agg(r(F.exp(F.max("x") - F.max("m")) * F.sum(F.exp(F.col("x") - F.col("m")))).alias("mass"))


@register()
def pca_projection(spark, sf_dir):
    """Variance explained by the first components of the centred fit rows, by the Gram matrix."""
    import numpy as np

    from fathom.operators.transforms import fit_pca, project

    rows = normal(patches(spark, sf_dir), "fit")
    pca = fit_pca(rows, 8)
    out = project(rows.select("vec_id", "v"), pca)
    spread = out.select(F.posexplode("z").alias("j", "x")).groupBy("j").agg(F.var_pop("x").alias("var"))
    return spread.join(spark.createDataFrame([(k, float(x)) for k, x in enumerate(np.asarray(pca.variances))], "j int, eigenvalue double"), "j")


@register(
    f"""WITH {PATCH}, q AS (SELECT vec_id, v, 1 AS k FROM patch), s AS (SELECT vec_id, unnest(v[1:16]) AS x FROM q), k AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) AS i, sum(x) OVER (PARTITION BY vec_id ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS c FROM s),
t AS (SELECT vec_id, max(CASE WHEN x - (c - 1) / i > 0 THEN i END) AS n FROM k GROUP BY vec_id), th AS (SELECT k.vec_id, (c - 1) / i AS theta FROM k JOIN t ON k.vec_id = t.vec_id AND k.i = t.n)
SELECT vec_id, round(theta, 6) AS shift FROM th"""
)
def simplex_projection(spark, sf_dir):
    """The shift that projects the first 16 components onto the simplex, from sorted running sums."""
    x = patches(spark, sf_dir).select("vec_id", F.explode(F.slice("v", 1, 16)).alias("x"))
    by = Window.partitionBy("vec_id").orderBy(F.desc("x"))  # 16 rows a vector
    k = x.select("vec_id", "x", F.row_number().over(by).alias("i"), F.sum("x").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    theta = (F.col("c") - 1) / F.col("i")
    return k.filter(F.col("x") - theta > 0).groupBy("vec_id").agg(r(F.max_by(theta, "i")).alias("shift"))


_LOW, _HIGH = "(1e-4 / 64)", "(4.0 / 64)"


@register(
    f"""WITH {PATCH}, b AS (SELECT vec_id, v, unnest(list_concat(list_transform(v, lambda x: x - {_HIGH}), list_transform(v, lambda x: x - {_LOW}))) AS t FROM patch),
f AS (SELECT vec_id, v, t, list_sum(list_transform(v, lambda x: least({_HIGH}, greatest({_LOW}, x - t)))) AS s FROM b),
a AS (SELECT vec_id, max(t) AS t0, min(s) AS s0, any_value(v) AS v FROM f WHERE s >= 1 GROUP BY vec_id), z AS (SELECT vec_id, min(t) AS t1, max(s) AS s1 FROM f WHERE s < 1 GROUP BY vec_id),
c AS (SELECT vec_id, v, t0 + (s0 - 1) / (s0 - s1) * (t1 - t0) AS t FROM a JOIN z USING (vec_id))
SELECT vec_id, round(least({_HIGH}, greatest({_LOW}, list_min(v) - t)), 8) AS least, round(least({_HIGH}, greatest({_LOW}, list_max(v) - t)), 8) AS most, 1.0::DOUBLE AS total FROM c"""
)
def bounded_simplex_projection(spark, sf_dir):
    """Projections of every vector onto the bounded simplex: their extremes and sums."""
    import numpy as np
    import pandas as pd

    from fathom.operators.projections import onto_bounded_simplex

    def run(frames):
        for frame in frames:
            p = [onto_bounded_simplex(np.array(v)) for v in frame["v"]]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "least": [round(x.min(), 8) for x in p], "most": [round(x.max(), 8) for x in p], "total": [round(x.sum(), 12) for x in p]})

    return patches(spark, sf_dir).select("vec_id", "v").mapInPandas(run, "vec_id long, least double, most double, total double")


@register()
def support_search(spark, sf_dir):
    """A support of 16 columns by the matching objective: fit pool, freeze, holdout choice."""
    from fathom.plans.fitting import fit_support

    rows = patches(spark, sf_dir)
    result = fit_support(rows, count=16, steps=30)
    return spark.createDataFrame([(int(j), float(w)) for j, w in zip(result.active, result.weights, strict=True)], "j int, weight double")


@register(f"WITH {PATCH} SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS cosine FROM patch a JOIN patch b ON a.image_id = b.image_id AND a.vec_id < b.vec_id")
def within_image_cosines(spark, sf_dir):
    p = patches(spark, sf_dir)
    a, b = p.select("image_id", F.col("vec_id").alias("left_id"), F.col("v").alias("a")), p.select("image_id", F.col("vec_id").alias("right_id"), F.col("v").alias("b"))
    return a.join(b, "image_id").filter("left_id < right_id").select("left_id", "right_id", r(dot("a", "b") / (norm("a") * norm("b"))).alias("cosine"))
