"""Split rules of the image collections, as queries over file tables, and the job that applies them.

Every rule takes a table with one row a candidate image and returns it with ``split``.  Counts are fixed
values of the published splits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import names
from fathom.operators import catalogue
from fathom.sources.files import list_files

#: Volumes of the official brain split when its id lists are missing: train, valid, test of normals; valid of abnormals.
BRAIN_FALLBACK, BRAIN_ABNORMAL_VALID = (424, 39, 162), 11
#: Slices of a brain volume: from, to, and every how many in train, valid and test.
BRAIN_SLICES, BRAIN_STEPS = (60, 100), {"train": 1, "valid": 10, "test": 8}
#: First so many normal and abnormal test images become validation images.
LIVER_VALID, RESC_VALID, OCT_VALID = (93, 73), (65, 50), 8
XRAY_TRAIN, XRAY_VALID = 8_000, 1_490
CROP = 256


def _place(*order: str, by: tuple[str, ...] = ()) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def brain_volumes(volumes: DataFrame, official: DataFrame | None = None) -> DataFrame:
    """``volumes(case_id, label)`` with ``split``; ``official(case_id, split)`` decides the normals if given."""
    normal, abnormal = volumes.filter("label = 0"), volumes.filter("label = 1")
    if official is not None:
        normal = normal.join(official.select("case_id", "split"), "case_id")
    else:
        train, valid, _ = BRAIN_FALLBACK
        place = F.col("place")
        normal = normal.withColumn("place", _place("case_id")).filter(place <= sum(BRAIN_FALLBACK))
        normal = normal.withColumn("split", F.when(place <= train, "train").when(place <= train + valid, "valid").otherwise("test")).drop("place")
    abnormal = abnormal.withColumn("split", F.when(_place("case_id") <= BRAIN_ABNORMAL_VALID, "valid").otherwise("test"))
    return normal.unionByName(abnormal)


def brain_slices(volumes: DataFrame) -> DataFrame:
    """One row a slice to take: ``case_id, label, split, z``."""
    first, last = BRAIN_SLICES
    step = F.lit(1)
    for split, every in BRAIN_STEPS.items():
        step = F.when(F.col("split") == split, every).otherwise(step)
    zs = F.sequence(F.lit(first), F.lit(last - 1))
    wanted = F.filter(zs, lambda z: (z - first) % step == 0)
    return volumes.select("case_id", "label", "split", F.explode(wanted).alias("z"))


def normal_slices(slices: DataFrame) -> DataFrame:
    """Of slices ``(.., label, most)`` the normal ones whose segmentation is empty, and all abnormal ones."""
    return slices.filter((F.col("label") == 1) | (F.col("most") < 1))


def _first_of_class(images: DataFrame, normal: int, abnormal: int) -> DataFrame:
    return images.withColumn("split", F.when(_place("path", by=("label",)) <= F.when(F.col("label") == 0, normal).otherwise(abnormal), "valid").otherwise("test"))


def liver(test: DataFrame) -> DataFrame:
    return _first_of_class(test, *LIVER_VALID)


def resc(test: DataFrame) -> DataFrame:
    return _first_of_class(test, *RESC_VALID)


def oct2017(test: DataFrame) -> DataFrame:
    """``test(path, class)``: the first images of each class, diseases and normals alike, validate."""
    return catalogue.ranked_split(test, ["class"], ["path"], OCT_VALID).withColumn("label", (F.upper("class") != "NORMAL").cast("int"))


def xray(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels(patientId, class, line)`` and ``found(patientId)``: the last label of an id counts, files must exist.

    The first normals train; validation is shared over the two classes in proportion.
    """
    rows = catalogue.last_label(labels, "patientId", "line", "class").join(found.select("patientId").distinct(), "patientId", "left_semi")
    rows = rows.withColumn("label", (F.col("class") != "Normal").cast("int"))
    normal = rows.filter("label = 0").withColumn("place", _place("patientId"))
    train = normal.filter(F.col("place") <= XRAY_TRAIN).drop("place").withColumn("split", F.lit("train"))
    rest = normal.filter(F.col("place") > XRAY_TRAIN).drop("place").unionByName(rows.filter("label = 1"))
    return train.unionByName(catalogue.proportional_split(rest, "label", "patientId", XRAY_VALID).select(*train.columns))


def crops(coordinates: DataFrame, slides: DataFrame, size: int = CROP) -> DataFrame:
    """``slide, path, left, top, size``: crops centred at ``coordinates(slide, x, y)``; ``path`` null if no slide fits.

    A slide fits by its stem, or by a stem that begins with the name.
    """
    by_name = slides.select(F.lower(names.stem(F.col("path"))).alias("stem"), "path")
    wanted = coordinates.withColumn("want", F.lower(F.regexp_replace("slide", r"\.[^.]*$", "")))
    exact = wanted.join(by_name.groupBy("stem").agg(F.min("path").alias("path")), F.col("want") == F.col("stem"), "left")
    prefix = F.broadcast(by_name.select(F.col("stem").alias("other"), F.col("path").alias("near")))  # one row a slide
    near = exact.filter("path is null").select("slide", "want").distinct().join(prefix, F.col("other").startswith(F.col("want"))).groupBy("slide").agg(F.min("near").alias("near"))
    half = size // 2
    return exact.join(near, "slide", "left").select("slide", F.coalesce("path", "near").alias("path"), (F.col("x") - half).alias("left"), (F.col("y") - half).alias("top"), F.lit(size).alias("size"))


def volume_pairs(files: DataFrame) -> DataFrame:
    """``volume, segmentation``: volumes and segmentations whose names belong together."""
    name = names.file_name(F.col("path"))
    volumes = files.filter(name.rlike(r"^(volume-|img)")).select(F.col("path").alias("volume"), names.segmentation_name(F.col("path")).alias("name"))
    segmentations = files.filter(name.rlike(r"^(segmentation-|label)")).select(F.col("path").alias("segmentation"), name.alias("name"))
    return volumes.join(segmentations, "name").select("volume", "segmentation")


@dataclass(frozen=True)
class Prepared:
    """What became of one dataset: ``ready``, ``reused``, ``processed`` or ``missing``, and its counts."""

    dataset: str
    status: str
    counts: dict[str, int]


def prepare(spark: SparkSession, roots: dict[str, str], build: dict[str, Callable[[SparkSession, str], DataFrame]], wanted: list[str]) -> list[Prepared]:
    """Reuse folders that are already laid out by split and class, build the others, and report the missing."""
    out = []
    for dataset in wanted:
        if dataset not in roots:
            out.append(Prepared(dataset, "missing", {}))
            continue
        files = list_files(spark, roots[dataset]).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
        parts = [catalogue.scan_split(files, roots[dataset], s) for s in catalogue.SPLITS]
        counts = {s: p.count() for s, p in zip(catalogue.SPLITS, parts, strict=True)}
        if counts["train"] and counts["test"]:
            out.append(Prepared(dataset, "reused", counts))
        elif dataset in build:
            rows = build[dataset](spark, roots[dataset]).groupBy("split").count().collect()
            out.append(Prepared(dataset, "processed", {r["split"]: r["count"] for r in rows}))
        else:
            out.append(Prepared(dataset, "missing", counts))
    return out
