"""Views of the driver's tables in the roles of the data model.

Five consecutive vectors are the patches of one image; an image's number decides its role; labels 8
and 9 are abnormal.  The 64 components are four layers of 16, or an 8 x 8 grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.vectors import doubles, layer

PATCHES, LAYERS, LAYER_WIDTH, GRID = 5, 4, 16, 8
KINDS = ("gamma", "quant", "shift")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, image_id, patch_no, role, y, v``."""
    image = F.expr("vec_id div 5")
    role = F.when(image % 5 <= 2, "fit").when(image % 5 == 3, "holdout").otherwise("test")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        image.alias("image_id"),
        (F.col("vec_id") % PATCHES).cast("int").alias("patch_no"),
        role.alias("role"),
        F.col("label").isin(8, 9).cast("int").alias("y"),
        doubles("embedding").alias("v"),
    )


def normal(rows: DataFrame, role: str) -> DataFrame:
    return rows.filter((F.col("role") == role) & (F.col("y") == 0))


def layer_vectors(rows: DataFrame, mode: str = "l2") -> DataFrame:
    """``... layer, vec``: one row a layer."""
    numbers = F.explode(F.array(*(F.lit(k) for k in range(LAYERS)))).alias("layer")
    return rows.select("*", numbers).withColumn("vec", layer("v", F.col("layer"), LAYER_WIDTH, mode))


def perturbed(rows: DataFrame) -> DataFrame:
    """``vec_id, kind, v, w``: the vector and its deterministic nuisance variants."""
    v = F.col("v")
    variants = {
        "gamma": F.transform(v, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(1.08))),
        "quant": F.transform(v, lambda x: F.floor(x * 100 + 0.5) / 100.0),
        "shift": F.transform(v, lambda x, j: x + 0.015 * (((j + F.col("vec_id")) % 7) / 3.0 - 1.0)),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), variants[k].alias("w")) for k in KINDS))).alias("variant")
    return rows.select("vec_id", "image_id", "v", each).select("vec_id", "image_id", "v", "variant.kind", "variant.w")


def coordinates(rows: DataFrame, column: str = "v") -> DataFrame:
    """``vec_id, image_id, j, x``."""
    return rows.select("vec_id", "image_id", F.posexplode(column).alias("j", "x"))


#: DuckDB: the same views as common table expressions.
PATCH = """patch AS (
  SELECT vec_id, vec_id // 5 AS image_id, (vec_id % 5)::INT AS patch_no,
         CASE WHEN (vec_id // 5) % 5 <= 2 THEN 'fit' WHEN (vec_id // 5) % 5 = 3 THEN 'holdout' ELSE 'test' END AS role,
         (label IN (8, 9))::INT AS y, embedding::DOUBLE[] AS v
  FROM embeddings)"""
COORD = "coord AS (SELECT vec_id, image_id, role, y, unnest(v) AS x, unnest(range(64)) AS j FROM patch)"
LAYER = """layer_raw AS (SELECT vec_id, image_id, role, y, l AS layer, v[16 * l + 1 : 16 * l + 16] AS raw FROM patch, (SELECT unnest(range(4)) AS l)),
layer_vec AS (SELECT vec_id, image_id, role, y, layer, list_transform(raw, lambda x: x / greatest(sqrt(list_dot_product(raw, raw)), 1e-12)) AS vec FROM layer_raw)"""
PERTURBED = """perturbed AS (
  SELECT vec_id, image_id, role, y, 'gamma' AS kind, v, list_transform(v, lambda x: sign(x) * pow(abs(x), 1.08)) AS w FROM patch
  UNION ALL SELECT vec_id, image_id, role, y, 'quant', v, list_transform(v, lambda x: floor(x * 100 + 0.5) / 100.0) FROM patch
  UNION ALL SELECT vec_id, image_id, role, y, 'shift', v, list_transform(v, lambda x, j: x + 0.015 * (((j - 1 + vec_id) % 7) / 3.0 - 1.0)) FROM patch)"""
