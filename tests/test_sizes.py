"""Work on larger tables: what a task holds stays bounded, and every row counts."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from fathom.operators import losses, neighbours
from fathom.plans import fitting


def brute(x, groups, refs, ref_groups, k, other_group):
    c = np.clip(x @ refs.T, -1.0, 1.0)
    if other_group:
        c[groups[:, None] == ref_groups[None, :]] = -np.inf
    return np.argsort(-c, axis=1, kind="stable")[:, :k]


#: Neighbours and whether they lie in other images, as the queries ask for them.
FORMS = {
    "knn_detection_metrics": (1, False),
    "knn_image_score": (1, False),
    "knn_leave_image_out": (1, True),
    "laplacian_score": (3, True),
    "layer_subset_local_score": (8, False),
    "normal_temperature": (8, True),
}


@pytest.mark.parametrize("name", FORMS)
def test_neighbours_hold_a_bounded_number_of_cosines(name):
    k, other_group = FORMS[name]
    x = neighbours._unit(np.random.default_rng(3).standard_normal((4000, 8)))
    ids, groups = np.arange(4000), np.arange(4000) // 5
    tracemalloc.start()
    found = pd.concat(neighbours._best(ids, groups, x, ids, groups, x, k, other_group))  # 128 MB of cosines
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    np.testing.assert_array_equal(found["ref_id"].to_numpy().reshape(4000, k), brute(x, groups, x, groups, k, other_group))


@pytest.fixture()
def many(spark):
    """Fifty references of ten images, every vector there twice or more, and queries among them."""
    x = np.random.default_rng(5).standard_normal((9, 6)) + 1
    v = x[np.arange(50) % 9]
    rows = spark.createDataFrame([(k, k // 5, v[k].tolist()) for k in range(50)], "vec_id long, image_id long, v array<double>")
    return v, np.arange(50) // 5, rows


def test_near_ties_count_every_reference(many, monkeypatch):
    v, groups, rows = many
    monkeypatch.setattr(losses, "against_memory", lambda *a, whole=losses.against_memory: whole(*a, 7))
    monkeypatch.setattr(losses, "HELD_BYTES", 1000)  # three broadcasts, of memories of at most seven rows
    got = {r["query_id"]: r["near_ties"] for r in losses.near_ties(rows, rows).collect()}
    same = (np.arange(50)[:, None] % 9 == np.arange(50)[None, :] % 9) & (groups[:, None] != groups[None, :])
    assert got == dict(enumerate(same.sum(1).tolist()))


def test_terms_over_memories_equal_those_over_one(many, monkeypatch):
    v, groups, rows = many
    active, p = np.array([0, 2, 5]), np.array([0.5, 0.3, 0.2])
    ask = lambda: [losses.matching_terms(rows, rows, active, p, 0.1), losses.relation_terms(rows, rows, active, p, 0.1, 2, 4)]
    want = [df.orderBy("query_id").toPandas().to_numpy(float) for df in ask()]
    monkeypatch.setattr(losses, "against_memory", lambda *a, whole=losses.against_memory: whole(*a, 7))
    monkeypatch.setattr(losses, "HELD_BYTES", 1000)
    for df, whole in zip(ask(), want, strict=True):
        np.testing.assert_allclose(df.orderBy("query_id").toPandas().to_numpy(float), whole, rtol=1e-9)
    assert (want[0][:, 1] == 45).all()


def test_support_searches_run_in_tasks(spark, monkeypatch):
    """The driver starts the searches and judges what they find; it evaluates no search itself."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8)) + 1.5
    roles = ["fit"] * 40 + ["holdout"] * 20
    rows = spark.createDataFrame([(k, k // 2, roles[k], 0, x[k].tolist()) for k in range(60)], "vec_id long, image_id long, role string, y int, v array<double>")

    def here(*_, **__):
        raise AssertionError("a search on the driver")

    for name in ("projected_gradient", "exchange", "pursue", "polish"):
        monkeypatch.setattr(fitting, name, here)
    found = fitting.fit_support(rows, count=3, steps=5)
    assert [c["id"] for c in found.pool] == list(range(len(found.pool))) and len(found.pool) % 5 == 0
    assert {c["source"] for c in found.pool} == {"uniform", "refit", "exchange", "pursuit", "polish"}
    assert found.weights.sum() == pytest.approx(1) and found.digest == fitting.frozen(found.pool)
