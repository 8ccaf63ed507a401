"""Path and name rules as column expressions: stems, aliases, pairings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_SUFFIX = r"(?i)\.(png|jpe?g|bmp|tiff?)$"
ARCHIVE_SUFFIX = r"(?i)\.(zip|tar|tgz|tbz2|txz|tar\.gz|tar\.bz2|tar\.xz)$"
#: Alias to dataset, first match wins; fixed values.
DATASETS = (
    ("brats", "brain"),
    ("brain", "brain"),
    ("lits", "liver"),
    ("btcv", "liver"),
    ("liver", "liver"),
    ("resc", "resc"),
    ("oct2017", "oct2017"),
    ("rsna", "xray"),
    ("chest", "xray"),
    ("xray", "xray"),
    ("camelyon", "camelyon16"),
)


def is_image(path: Column) -> Column:
    return path.rlike(IMAGE_SUFFIX)


def is_archive(path: Column) -> Column:
    return path.rlike(ARCHIVE_SUFFIX)


def archive_stem(path: Column) -> Column:
    """The file name without its (possibly double) archive suffix."""
    return F.regexp_replace(file_name(path), r"(?i)(\.tar\.(gz|bz2|xz)|\.(zip|tar|tgz|tbz2|txz))$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def mask_stem(path: Column) -> Column:
    """A case-folded stem without a trailing mark that says the file is a mask."""
    return F.regexp_replace(F.lower(stem(path)), r"[_-]?(anomaly)?[_-]?(mask|label|seg|gt)$", "")


def safe_member(path: Column) -> Column:
    """Whether an archive member stays below the folder it is unpacked to."""
    return ~(path.startswith("/") | path.rlike(r"^[A-Za-z]:") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)"))


def dataset_of(path: Column, aliases=DATASETS) -> Column:
    """The dataset whose alias stands first in the list among those the path contains; ``-`` and ``_`` do not count."""
    folded = F.regexp_replace(F.lower(path), "[-_]", "")
    found = F.lit(None).cast("string")
    for alias, name in reversed(aliases):
        found = F.when(folded.contains(alias), F.lit(name)).otherwise(found)
    return found


def segmentation_name(path: Column) -> Column:
    """The name of the segmentation that belongs to a volume."""
    return F.regexp_replace(F.regexp_replace(file_name(path), r"^volume-", "segmentation-"), r"^img", "label")
