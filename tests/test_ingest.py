"""Split rules on small file tables."""

from pyspark.sql import functions as F

from fathom.functions import images
from fathom.plans import ingest


def counts(rows, *by):
    return {tuple(r[b] for b in by): r["count"] for r in rows.groupBy(*by).count().collect()}


def test_brain_volumes_and_slices(spark):
    volumes = spark.createDataFrame([(f"n{k:04d}", 0) for k in range(700)] + [(f"a{k:03d}", 1) for k in range(30)], "case_id string, label int")
    got = ingest.brain_volumes(volumes)
    assert counts(got, "label", "split") == {(0, "train"): 424, (0, "valid"): 39, (0, "test"): 162, (1, "valid"): 11, (1, "test"): 19}
    official = spark.createDataFrame([("n0001", "test"), ("n0002", "train")], "case_id string, split string")
    assert counts(ingest.brain_volumes(volumes, official).filter("label = 0"), "split") == {("test",): 1, ("train",): 1}
    slices = ingest.brain_slices(got.filter("case_id in ('n0000', 'n0424', 'n0463')"))
    assert counts(slices, "split") == {("train",): 40, ("valid",): 4, ("test",): 5}
    assert ingest.normal_slices(spark.createDataFrame([(0, 0.0), (0, 2.0), (1, 2.0)], "label int, most double")).count() == 2


def test_counted_splits(spark):
    test = spark.createDataFrame([(f"/t/{label}/{k:03d}.png", label) for label in (0, 1) for k in range(120)], "path string, label int")
    assert counts(ingest.liver(test), "label", "split") == {(0, "valid"): 93, (0, "test"): 27, (1, "valid"): 73, (1, "test"): 47}
    assert counts(ingest.resc(test), "label", "split")[(1, "valid")] == 50
    classes = spark.createDataFrame([(f"/{c}/{k}.png", c) for c in ("NORMAL", "CNV", "DME", "DRUSEN") for k in range(10)], "path string, class string")
    got = counts(ingest.oct2017(classes), "split", "label")
    assert got == {("valid", 0): 8, ("valid", 1): 24, ("test", 0): 2, ("test", 1): 6}


def test_xray_and_crops(spark):
    labels = spark.createDataFrame([(f"p{k:05d}", "Normal" if k < 9000 else "Opacity", k) for k in range(12_000)] + [("p00000", "Opacity", 20_000), ("gone", "Normal", 1)], "patientId string, class string, line int")
    found = labels.filter("patientId <> 'gone'").select("patientId")
    got = counts(ingest.xray(labels, found), "split", "label")
    assert got[("train", 0)] == 8000 and sum(v for (s, _), v in got.items() if s == "valid") == 1490 and sum(got.values()) == 12_000
    spots = spark.createDataFrame([("tumor_1.tif", 500, 600), ("test_9", 300, 300), ("none", 1, 1)], "slide string, x long, y long")
    slides = spark.createDataFrame([("/s/Tumor_1.tif",), ("/s/test_9_mask.tif",)], "path string")
    rows = {r["slide"]: r for r in ingest.crops(spots, slides).collect()}
    assert (rows["tumor_1.tif"]["left"], rows["tumor_1.tif"]["top"]) == (372, 472) and rows["test_9"]["path"].endswith("test_9_mask.tif") and rows["none"]["path"] is None
    pairs = ingest.volume_pairs(spark.createDataFrame([("/v/volume-1.nii",), ("/v/segmentation-1.nii",), ("/v/img02.nii",), ("/v/other.nii",)], "path string"))
    assert [tuple(r) for r in pairs.collect()] == [("/v/volume-1.nii", "/v/segmentation-1.nii")]


def test_prepared_folders_are_reused(spark, tmp_path):
    pixel = images.png_bytes(images.np.zeros((2, 2), dtype="uint8"))
    for p in ("a/train/good/img/1.png", "a/test/good/img/2.png", "a/test/Ungood/img/3.png", "b/raw/4.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(pixel)
    build = {"b": lambda s, root: s.createDataFrame([("train",), ("test",)], "split string").withColumn("path", F.lit(root))}
    got = ingest.prepare(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}, build, ["a", "b", "c"])
    assert [(p.dataset, p.status) for p in got] == [("a", "reused"), ("b", "processed"), ("c", "missing")] and got[0].counts == {"train": 1, "valid": 0, "test": 2}
