"""Image catalogues as queries over path tables: splits, masks, coverage, ranked splits.

A path table has one row a file (``path``); nothing here opens a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import names

#: Folder names that mean a split or a class, in order of preference; fixed values.
SPLITS = {"train": ("train", "Train"), "valid": ("valid", "val", "Valid", "Val"), "test": ("test", "Test")}
NORMAL, ABNORMAL = ("good",), ("Ungood", "ungood", "bad")
MASK_MARK = "mask"


def scan_split(files: DataFrame, root: str, split: str) -> DataFrame:
    """``path, label, split`` of the images below the split's folder: good is 0, its opposites 1.

    Files below a folder named like a mask are no images.  Of several spellings of the split the first that
    exists is taken.
    """
    inside = files.filter(F.col("path").startswith(root.rstrip("/") + "/")).withColumn("below", F.split(F.substring("path", len(root.rstrip("/")) + 2, 1 << 20), "/"))
    rank = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(SPLITS[split]))):
        rank = F.when(F.get("below", F.lit(0)) == name, k).otherwise(rank)
    ranked = inside.withColumn("rank", rank).filter("rank is not null")
    first = ranked.agg(F.min("rank").alias("rank"))
    chosen = ranked.join(F.broadcast(first), "rank")
    folders = F.expr("slice(below, 2, greatest(size(below) - 2, 0))")
    label = F.when(F.exists(folders, lambda f: f.isin(*NORMAL)), 0).when(F.exists(folders, lambda f: f.isin(*ABNORMAL)), 1)
    plain = ~F.exists(folders, lambda f: F.lower(f).contains(MASK_MARK))
    return chosen.withColumn("label", label).filter(plain & F.col("label").isNotNull() & names.is_image(F.col("path"))).select("path", "label", F.lit(split).alias("split")).orderBy("path")


def match_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """``path, mask_path, candidates`` by the first rule that finds a mask.

    Rules: the same path below the root (``key``), the same parent and stem, the same file name, the same
    stem; all case-folded.  Both tables have ``path`` and ``key``.  ``candidates`` above one is ambiguous.
    """
    p = F.col("path")
    keys = {
        "exact": F.lower(F.regexp_replace("key", r"\.[^./]*$", "")),
        "parent": F.concat_ws("/", F.lower(names.parent(p)), names.mask_stem(p)),
        "name": F.lower(names.file_name(p)),
        "stem": names.mask_stem(p),
    }
    out = images
    for rule, key in keys.items():
        found = masks.groupBy(key.alias(f"k_{rule}")).agg(F.min("path").alias(f"m_{rule}"), F.count("*").alias(f"n_{rule}"))
        out = out.withColumn(f"i_{rule}", key).join(found, F.col(f"i_{rule}") == F.col(f"k_{rule}"), "left").drop(f"k_{rule}", f"i_{rule}")
    candidates = F.coalesce(*(F.col(f"n_{rule}") for rule in keys))
    return out.select("path", F.coalesce(*(F.col(f"m_{rule}") for rule in keys)).alias("mask_path"), F.coalesce(candidates, F.lit(0)).alias("candidates"))


def mask_coverage(samples: DataFrame) -> DataFrame:
    """``abnormal, with_mask`` of ``samples(label, mask_path)``."""
    bad = F.col("label") == 1
    return samples.agg(F.count(F.when(bad, 1)).alias("abnormal"), F.count(F.when(bad & F.col("mask_path").isNotNull(), 1)).alias("with_mask"))


def uncovered(samples: DataFrame) -> DataFrame:
    """Abnormal samples without a mask: a pixel dataset must have none."""
    return samples.filter((F.col("label") == 1) & F.col("mask_path").isNull())


def ranked_split(rows: DataFrame, by: list[str], order: list[str], valid: Column | int, split: str = "split") -> DataFrame:
    """In each group of ``by`` the first ``valid`` rows are validation, the rest test."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(split, F.when(place <= valid, "valid").otherwise("test"))


def last_label(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """For each key the value of its last row."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def proportional_split(rows: DataFrame, by: str, order: str, total: int) -> DataFrame:
    """``total`` validation rows shared over the groups in proportion, rounded half to even; the rest test."""
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"))
    share = counts.crossJoin(F.broadcast(whole)).select(by, F.bround(F.col("_n") * total / F.col("_all")).cast("long").alias("_valid"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.join(share, by).withColumn("split", F.when(place <= F.col("_valid"), "valid").otherwise("test")).drop("_valid")


def split_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split", "label").agg(F.count("*").alias("n"))


def first_dataset_roots(folders: DataFrame) -> DataFrame:
    """``dataset, path``: the first folder (in path order) for each dataset's alias."""
    return folders.withColumn("dataset", names.dataset_of(F.col("path"))).filter("dataset is not null").groupBy("dataset").agg(F.min("path").alias("path"))


def preferred(rows: DataFrame, by: list[str], priority: str) -> DataFrame:
    """Of ranked alternatives the best one in each group."""
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(*by).orderBy(priority))).filter("_p = 1").drop("_p")
