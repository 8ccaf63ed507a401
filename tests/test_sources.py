"""Archives, readers, catalogues, provenance, streams and runs on small trees and tables."""

import gzip
import io
import struct
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import images, names
from fathom.operators import catalogue, provenance, reports, sampling, selection, statistics
from fathom.operators.views import KINDS, normal, patches, perturbed
from fathom.plans import fitting, roster
from fathom.sources import archives, files, tables
from fathom.streaming import incremental

SF = "/root/testdata/sf0.001"


def picture(seed=0, shape=(8, 8)):
    return np.random.default_rng(seed).integers(0, 256, shape).astype(np.uint8)


# --- archives and readers


def test_archives_unpack_nested_and_once(tmp_path):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as t:
        info = tarfile.TarInfo("deep/a.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    (tmp_path / "archives").mkdir()
    with zipfile.ZipFile(tmp_path / "archives/set.zip", "w") as z:
        z.writestr("x/inner.tar.gz", inner.getvalue())
    found = archives.unpack_all(tmp_path)
    assert len(found) == 2 and next(tmp_path.rglob("a.txt")).read_text() == "hi"
    assert archives.unpack_all(tmp_path) == found
    with pytest.raises(ValueError, match="nested"):
        archives.unpack_all(tmp_path, deepest=0)
    (tmp_path / "archives/set.zip").unlink()
    assert len(archives.unpack_all(tmp_path)) == 2  # without archives, what is there is used


@pytest.mark.parametrize("member", ["../out.txt", "/abs.txt", "a/../../b"])
def test_archives_refuse_unsafe_members(tmp_path, member):
    path = tmp_path / "bad.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(member, "x")
    with pytest.raises(ValueError, match="unsafe"):
        archives.unpack(path, tmp_path / "out")
    assert not archives.safe(member)


def nifti_bytes(volume):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *volume.shape, 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, 4, 16)
    struct.pack_into("<3f", head, 108, 352.0, 2.0, 1.0)
    return bytes(head) + volume.astype("<i2").tobytes(order="F")


def dicom_bytes(pixels, photometric=b"MONOCHROME1 "):
    def element(group, number, vr, data):
        head = struct.pack("<HH2s", group, number, vr)
        return head + (struct.pack("<HI", 0, len(data)) if vr == b"OW" else struct.pack("<H", len(data))) + data

    short = lambda v: struct.pack("<H", v)
    body = [(0x0028, 0x0004, b"CS", photometric), (0x0028, 0x0010, b"US", short(pixels.shape[0])), (0x0028, 0x0011, b"US", short(pixels.shape[1]))]
    body += [(0x0028, 0x0100, b"US", short(16)), (0x0028, 0x0103, b"US", short(0)), (0x7FE0, 0x0010, b"OW", pixels.astype("<u2").tobytes())]
    return bytes(128) + b"DICM" + element(0x0002, 0x0010, b"UI", b"1.2.840.10008.1.2.1\0") + b"".join(element(*e) for e in body)


def test_readers_decode_volumes_and_pictures(spark, tmp_path):
    volume = np.arange(2 * 3 * 4).reshape(2, 3, 4)
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.nii.gz").write_bytes(gzip.compress(nifti_bytes(volume)))
    rows = files.read_arrays(spark, str(tmp_path / "v"), "nifti")
    got = rows.first()
    assert got["shape"] == [2, 3, 4] and np.array_equal(np.array(got["values"]).reshape(2, 3, 4), volume * 2 + 1)
    cut = files.volume_slices(rows, 1, 4, 2).orderBy("z").collect()
    assert [r["z"] for r in cut] == [1, 3] and cut[0]["values"] == (volume[:, :, 1] * 2.0 + 1).ravel().tolist()
    x = np.array([[1, 2], [3, 1000]])
    assert np.array_equal(files.dicom(dicom_bytes(x)), 1000 - x) and np.array_equal(files.dicom(dicom_bytes(x, b"MONOCHROME2 ")), x)
    (tmp_path / "p").mkdir()
    grey, rgb = picture(1), picture(2, (5, 7, 3))
    (tmp_path / "p/a.png").write_bytes(images.png_bytes(grey))
    (tmp_path / "p/b.png").write_bytes(images.png_bytes(rgb))
    found = {r["path"][-5:]: r for r in files.read_arrays(spark, str(tmp_path / "p"), "png", "*.png").collect()}
    assert np.array_equal(np.array(found["a.png"]["values"]).reshape(8, 8), grey) and found["b.png"]["shape"] == [5, 7, 3]
    assert files.list_files(spark, str(tmp_path / "p")).count() == 2 and files.digests(spark, str(tmp_path / "p")).count() == 2
    (tmp_path / "c.txt").write_text("s1,10,20\ns2,30,40\n")
    assert [tuple(r) for r in files.read_coordinates(spark, str(tmp_path / "c.txt")).orderBy("slide").collect()] == [("s1", 10, 20), ("s2", 30, 40)]


def test_metric_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5, "[0.1, 0.2]"), ("b", float("nan"), "[nan, 0.3]")], "method string, auroc double, ci string")
    tables.write_csv(rows, tmp_path / "m.csv")
    got = {r["method"]: r for r in tables.read_metrics(spark, str(tmp_path / "m.csv"), ("ci",)).collect()}
    assert got["b"]["auroc"] is None and got["a"]["ci"] == [0.1, 0.2] and got["b"]["ci"] == [None, 0.3]
    with pytest.raises(ValueError):
        tables.write_csv(rows, tmp_path / "n.csv", limit=1)
    wide = spark.createDataFrame([("p", 0, 0.1, 0.2)], "image_path string, label int, m1 double, m2 double")
    long = tables.long_predictions(wide)
    assert long.count() == 2 and tables.wide_predictions(long, ["m1", "m2"]).first() == wide.first()
    tables.write_json({"b": np.arange(2), "a": 1}, tmp_path / "x.json")
    assert files.read_records(spark, str(tmp_path / "x.json")).first()["b"] == [0, 1]


# --- image arithmetic


def test_image_arithmetic():
    assert (images.stretched(np.full((4, 4), 7.0)) == 0).all()
    v = np.append(np.linspace(0, 1, 1000), [np.nan, np.inf]).reshape(2, 501)
    assert images.stretched(v).max() == 255 and images.stretched(v).min() == 0
    assert images.windowed(np.array([-10.0, 0, 50, 100, 200]), (0, 100)).tolist() == [0, 0, 127, 255, 255]
    table = images.equalisation_table(np.bincount([0] * 50 + [10] * 5 + [200] * 5, minlength=256))
    assert table[0] == 0 and table[10] == 127 // 150 * 120 + int(127 / 150 * 120 + 30) and table[255] == 255
    box = images.letterbox(picture(3, (10, 20, 3)), 16, [0.5] * 3, [0.5] * 3)[1]
    assert box == (4, 0, 8, 16)
    mask = images.boxed_mask(np.eye(10, dtype=int) * 3, 16, (4, 0, 8, 16))
    assert set(np.unique(mask)) == {0, 1} and not mask[:4].any()
    x = (picture(4, (9, 9, 3)) / 255 - 0.5) / 0.25
    for kind in ("noise", "blur", "gamma", "resolution"):
        assert images.perturb(x, kind, [0.5] * 3, [0.25] * 3, np.random.default_rng(1)).shape == x.shape
    with pytest.raises(ValueError):
        images.perturb(x, "other", [0.5] * 3, [0.25] * 3, np.random.default_rng(1))
    assert images.blended_panels(picture(5), picture(6) > 99, [np.ones((8, 8))]).shape == (8, 24, 3)


# --- catalogues


def test_catalogue_scans_classes_and_matches_masks(spark):
    paths = [f"/d/liver/train/good/img/{k}.png" for k in range(4)] + ["/d/liver/Test/good/img/a.png", "/d/liver/Test/Ungood/img/b.PNG", "/d/liver/Test/Ungood/img/c.png", "/d/liver/Test/Ungood/anomaly_mask/b_mask.png", "/d/liver/Test/Ungood/img/notes.txt"]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    assert catalogue.scan_split(table, "/d/liver", "train").count() == 4
    test = catalogue.scan_split(table, "/d/liver", "test")
    assert {(r["path"][-5:], r["label"]) for r in test.collect()} == {("a.png", 0), ("b.PNG", 1), ("c.png", 1)}
    key = F.regexp_replace("path", ".*/(img|anomaly_mask)/", "")
    masks = table.filter("path like '%mask%'").withColumn("key", key)
    found = {r["path"][-5:]: r for r in catalogue.match_masks(test.withColumn("key", key), masks).collect()}
    assert found["b.PNG"]["mask_path"].endswith("b_mask.png") and found["b.PNG"]["candidates"] == 1 and found["c.png"]["mask_path"] is None
    joined = test.join(catalogue.match_masks(test.withColumn("key", key), masks), "path")
    assert tuple(catalogue.mask_coverage(joined).first()) == (2, 1) and catalogue.uncovered(joined).count() == 1
    with pytest.raises(ValueError, match="mask"):
        reports.expect_none(catalogue.uncovered(joined), "abnormal images without a mask")
    roots = spark.createDataFrame([("/x/BraTS_2021",), ("/x/a-liver",), ("/y/lits",), ("/z/other",)], "path string")
    assert {(r["dataset"], r["path"]) for r in catalogue.first_dataset_roots(roots).collect()} == {("brain", "/x/BraTS_2021"), ("liver", "/x/a-liver")}
    stems = spark.createDataFrame([("a/set.tar.gz",), ("b/volume-12.nii",), ("c/img0001.nii",)], "path string").select(names.archive_stem(F.col("path")), names.segmentation_name(F.col("path"))).collect()
    assert stems[0][0] == "set" and stems[1][1] == "segmentation-12.nii" and stems[2][1] == "label0001.nii"


def test_ranked_and_proportional_splits(spark):
    rows = spark.createDataFrame([(c, k) for c, n in (("CNV", 30), ("NORMAL", 9)) for k in range(n)], "c string, k int")
    assert catalogue.ranked_split(rows, ["c"], ["k"], 8).filter("split = 'valid'").count() == 16
    got = {r["c"]: r["n"] for r in catalogue.proportional_split(rows, "c", "k", 10).filter("split = 'valid'").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert got == {"CNV": 8, "NORMAL": 2}
    assert catalogue.last_label(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, n int, l string"), "id", "n", "l").first()["l"] == "y"


# --- sampling, selection, reports, provenance


def test_samples_are_seeded_and_bounded():
    assert np.array_equal(sampling.index_sample(10, 0, 1), np.arange(10)) and len(sampling.index_sample(100, 7, 1)) == 7
    assert np.array_equal(sampling.reservoir_positions(5, 8, 1), np.arange(5))
    kept = sampling.reservoir_positions(1000, 16, 42)
    assert len(set(kept.tolist())) == 16 and np.array_equal(kept, sampling.reservoir_positions(1000, 16, 42))
    roles = sampling.role_partition(list(range(30)), {"fit": 18, "select": 6, "audit": 6}, 3, {"fit": [1, 2]})
    assert sorted(sum(roles.values(), [])) == list(range(30)) and {1, 2} <= set(roles["fit"])
    fit, held = sampling.holdout_split(np.arange(20), 0.25, 5)
    assert len(held) == 5 and not set(fit) & set(held)
    with pytest.raises(ValueError):
        sampling.holdout_split(np.arange(3), 0.7, 1)
    assert 0 <= sampling.derived_seed("r", 1, "liver", 0) < 1 << 63


def test_guarded_choice_golden(spark):
    rows = [(0, 1.0, 1.0, 2.0), (1, 1.05, 0.8, 1.0), (2, 1.2, 0.5, 0.5), (3, 1.01, 1.1, 0.1)]
    c = spark.createDataFrame(rows, "id int, mean double, mse double, cvar double")
    assert tuple(selection.guarded_choice(c, F.lit(0), F.lit(0.1), 1.0).first()) == (1, 2)
    trace = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 2.0), ("a", 2, 2.0)], "run string, step int, value double")
    assert selection.descent_violations(trace).count() == 1


def test_tail_and_cluster_golden(spark):
    x = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 7.0)], "g int, x double")
    assert [statistics.upper_tail_mean(x, ["g"], f).first()["cvar"] for f in (0.5, 1.0, 0.1)] == pytest.approx([8 / 1.5, 10 / 3, 7])
    v, g = np.array([1.0, 2, 3, 7, 8, 9]), [0, 0, 1, 2, 2, 2]
    got = statistics.cluster_standard_error(spark.createDataFrame(list(zip(g, v.tolist(), strict=True)), "g int, x double"), "g").first()
    d = v - v.mean()
    assert got["se"] == pytest.approx(np.sqrt(1.5 * ((d[0] + d[1]) ** 2 + d[2] ** 2 + d[3:].sum() ** 2)) / 6)
    x = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1]])
    assert statistics.covering_support(x, np.array([0, 1, 2]), 2) is None
    assert statistics.covering_support(np.array([[1.0, 0, 1], [0, 1, 1]]), np.array([0, 1, 2]), 1).tolist() == [2]


def test_variability_does_not_depend_on_partitions(spark):
    rows = [(k, [10.0 * k, 4.0], [10.0 * k + 2, 4.25], "noise") for k in range(6)] + [(k, [10.0 * k, 4.0], [10.1 * k, 4.08], "gamma") for k in range(6)]
    pairs = spark.createDataFrame(rows, "vec_id int, v array<double>, w array<double>, kind string")
    want = {("noise", 0): 4 / (np.var([10 * k for k in range(6)]) + 1e-6), ("noise", 1): 0.0625 / 1e-6}
    for n in (1, 5):
        got = {(r["kind"], r["j"]): r["ratio"] for r in statistics.variability(pairs.repartition(n), ["kind"]).collect()}
        assert all(got[k] == pytest.approx(v) for k, v in want.items())
    statistics.covered_alike(pairs)
    with pytest.raises(ValueError):
        statistics.covered_alike(pairs.filter("vec_id > 0 or kind = 'noise'"))


def test_reports_and_audits(spark):
    rows = [("d", f"m_seed{k}", float(k)) for k in range(5)] + [("d", "one", 0.5), ("e", "one", float("nan"))]
    m = spark.createDataFrame(rows, "dataset string, method string, auroc double")
    got = {(r["dataset"], r["family"]): r for r in reports.family_summary(m, ["dataset"], ["auroc"]).collect()}
    assert got[("d", "m")]["auroc_mean"] == 2.0 and got[("d", "m")]["auroc_sd"] == pytest.approx(np.std(range(5), ddof=1))
    assert got[("d", "one")]["auroc_sd"] == 0.0 and got[("e", "one")]["auroc_mean"] is None
    assert reports.missing_combinations(m, "dataset", "method").count() == 5 and reports.unequal_method_sets(m, "dataset").count() == 5
    assert reports.out_of_range(m, ["auroc"]).count() == 4 and reports.not_unique(m.union(m), ["dataset", "method"]).count() == 7


def test_provenance(spark, tmp_path):
    assert provenance.config_fingerprint({"a": 1, "b": [2]}) == provenance.config_fingerprint({"b": [2], "a": 1})
    for end in (b"\n", b"\r\n"):
        (tmp_path / "x.py").write_bytes(b"a = 1" + end)
        first = provenance.code_fingerprint(tmp_path)
    (tmp_path / "x.py").write_bytes(b"a = 1\n")
    assert first == provenance.code_fingerprint(tmp_path)
    metrics = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "method string, auroc double")
    ok = dict(metadata={"v": 1}, progress={"stage": "complete"}, expected={"v": 1}, methods=["a", "b"], bounded=["auroc"])
    assert provenance.may_resume(metrics, **ok) and not provenance.may_resume(metrics, **ok | {"methods": ["a"]}) and not provenance.may_resume(metrics, **ok | {"metadata": {"v": 2}})
    stages = spark.createDataFrame([("x", "complete"), ("y", "fit")], "dataset string, stage string")
    have = spark.createDataFrame([("x",), ("y",)], "dataset string")
    assert [r[0] for r in provenance.completed_scope(stages, have).collect()] == ["y"]
    assert provenance.merged([have.filter("dataset = 'x'"), have.filter("dataset = 'y'")], {"x", "y"}).count() == 2
    with pytest.raises(ValueError):
        provenance.merged([have, have], {"x", "y"})
    with pytest.raises(ValueError):
        provenance.below(tmp_path / "../out", tmp_path)
    assert provenance.table_digest(metrics, metrics.columns).first() == provenance.table_digest(metrics.repartition(3), metrics.columns).first()


def test_roster_has_unique_names():
    found = roster.branches()
    names_ = roster.roster(found)
    assert len(found) == 6 and len(names_) == len(set(names_)) and "main" in names_ and "layer_l2_local_main" in names_
    assert roster.task_plan([1, 2], ["a", "b"], (2, "a"))[0] == (2, "a")
    with pytest.raises(ValueError):
        roster.expand(("a", "a"))


# --- streams and runs


def test_streamed_moments_equal_one_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(3).tolist(), rng.standard_normal(3).tolist(), "g") for k in range(30)]
    pairs = spark.createDataFrame(rows, "vec_id int, v array<double>, w array<double>, kind string")
    for k in range(3):
        pairs.filter(f"vec_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = incremental.Accumulated(spark, str(tmp_path / "state"), incremental.moments, incremental.merge_moments)
    query = state.start(stream, str(tmp_path / "check"))
    query.awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir())
    assert last == 2
    got = {r["j"]: r["ratio"] for r in incremental.ratios(state.read(last)).collect()}
    want = {r["j"]: r["ratio"] for r in statistics.variability(pairs, ["kind"]).collect()}
    assert got == pytest.approx(want)


def test_streamed_histogram(spark, tmp_path):
    rows = spark.createDataFrame([(k % 2, k / 50) for k in range(100)], "y int, s double")
    rows.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = incremental.stream_histogram(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hist").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("hist").agg(F.sum("pos"), F.sum("neg")).first()
    assert tuple(got) == (50, 50)


def test_memory_samples_merge(spark):
    rows = spark.range(500).select(F.col("id").alias("vec_id"))
    whole = {r["vec_id"] for r in incremental.memory_state(rows, 20, 1).collect()}
    parts = [incremental.memory_state(rows.filter(f"vec_id % 2 = {k}"), 20, 1) for k in range(2)]
    assert {r["vec_id"] for r in incremental.merge_memory(20)(*parts).collect()} == whole


def test_fit_support_on_more_rows_than_the_driver_holds(spark, monkeypatch):
    monkeypatch.setattr(fitting, "FIT_ROWS", 20)
    monkeypatch.setattr(fitting.local_rows, "__defaults__", (20,))
    sizes = []
    original = fitting.Nuisance
    monkeypatch.setattr(fitting, "Nuisance", lambda x, changed: sizes.append([len(x), *map(len, changed)]) or original(x, changed))
    rows = patches(spark, SF)
    assert normal(rows, "fit").count() > 20
    result = fitting.fit_support(rows, count=6, steps=3, rounds=0)
    assert sizes == [[20, 20, 20, 20]] and len(result.active) == 6


def test_fit_and_evaluate_small(spark):
    rows = patches(spark, SF)
    result = fitting.fit_support(rows, count=12, steps=10, rounds=0)
    assert len(result.active) == 12 and result.weights.sum() == pytest.approx(1) and result.digest
    from fathom.operators.transforms import Method, fit_pca, represent

    layers = (0, 2)
    pca = fit_pca(represent(normal(rows, "fit"), Method("x", layers=layers), 16), 4)
    methods = [Method("raw", layers=layers), Method("support", "support", (0, 1, 2, 3), "none", tuple(result.active.tolist()), tuple(result.weights.tolist())), Method("pca", "pca", layers, pca=pca), Method("random", "random", layers, active=(1, 5, 9))]
    got = {r["method"]: r for r in fitting.evaluate(rows, methods, 16, 0.4).collect()}
    assert set(got) == {"raw", "support", "pca", "random"} and all(0 <= r["auroc"] <= 1 for r in got.values())
    with pytest.raises(ValueError, match="normal training"):
        fitting.build_memory(rows, methods[0], 16)
    w, error = fitting.fit_gram_support(normal(rows, "fit"), 10, np.array([1e-4, 1e-3]), 0.5)
    assert (w > 0).sum() <= 10 and error < 1
    assert fitting.fit_cosine_support(normal(rows, "fit"), 8).weights.sum() == pytest.approx(1)
    chosen, _, _ = fitting.fit_layers(normal(rows, "fit"), 4, 16, np.arange(4.0))
    assert chosen and perturbed(rows).select("kind").distinct().count() == len(KINDS)
    assert fitting.run_tasks(spark, [1, 2, 3], lambda t: t * 2) == [2, 4, 6]
