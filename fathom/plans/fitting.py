"""Fit, memory, scoring: the jobs of a run, over DataFrames of feature rows.

Only audited samples of stated size, Gram matrices and supports of at most a few hundred columns reach
the driver.  The candidate pool of a fit is frozen (hashed) before any holdout row is read.
"""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import losses, metrics, neighbours, sampling, selection, statistics
from fathom.operators.losses import CosineGramObjective, LocalObjective, MatchingObjective, Nuisance, QuadraticObjective, RelationObjective, row_weights
from fathom.operators.projections import onto_simplex
from fathom.operators.provenance import frozen
from fathom.operators.solvers import (
    Outcome, choose_layers, exchange, fista, gate_layers, guarded, pivot_columns, polish, projected_gradient, prune_columns, prune_support, pursue, refit_columns, relevant_columns, ridge_whitened,
)
from fathom.operators.transforms import Method, represent

#: Rows of a fit sample that the driver may hold.
FIT_ROWS = 4_096


def local_rows(rows: DataFrame, limit: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, image ids and vectors of a hashed sample of at most ``limit`` rows, in order of their ids."""
    got = sampling.hashed_sample(rows.select("vec_id", "image_id", "v"), "vec_id", limit, 0).orderBy("vec_id").toPandas()
    if got.empty:
        raise ValueError("there are no rows to fit on")
    return got["vec_id"].to_numpy(), got["image_id"].to_numpy(), np.array(got["v"].tolist(), dtype=np.float64)


@dataclass
class Fit:
    active: np.ndarray
    weights: np.ndarray
    pool: list[dict] = field(default_factory=list)
    digest: str = ""
    chosen: int = 0
    beta: float = 0.0


def starts(gram: np.ndarray, nuisance_energy: np.ndarray, count: int) -> list[np.ndarray]:
    """Supports to start from: most energy, most leverage, most energy over nuisance, and pivoted columns."""
    energy = np.diag(gram)
    leverage = ridge_whitened(gram, count)[1]
    ranked = [energy, leverage, energy / (nuisance_energy + statistics.EPSILON)]
    out = [np.sort(np.argsort(-r, kind="stable")[:count]) for r in ranked] + [np.sort(np.array(pivot_columns(gram, count)))]
    return [a for k, a in enumerate(out) if not any(np.array_equal(a, b) for b in out[:k])]


def contrast_starts(x: np.ndarray, groups: np.ndarray, unstable: np.ndarray, count: int, rank: int = 8) -> list[np.ndarray]:
    """Pivoted supports of the centred columns, of weighted changes to the nearest and the ``rank``-th neighbour in
    other images, and of these with unstable columns held down."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    near, far, best = np.empty(len(x), int), np.empty(len(x), int), np.empty(len(x))
    for at in range(0, len(x), 512):
        own = slice(at, at + 512)
        c = np.where(groups[own, None] != groups, unit[own] @ unit.T, -np.inf)
        order = np.argsort(-c, axis=1, kind="stable")[:, :rank]
        seen = np.isfinite(np.take_along_axis(c, order, 1)).sum(1)
        if (seen < 2).any():
            raise ValueError("a query has fewer than two references in other images")
        near[own], far[own] = order[:, 0], order[np.arange(len(order)), seen - 1]
        best[own] = np.take_along_axis(c, order[:, :1], 1)[:, 0]
    root = np.sqrt(row_weights(np.maximum(1 - best, 0)) / 2)[:, None]
    moved = np.concatenate([(x - x[near]) * root, (x - x[far]) * root])
    centred = x - x.mean(0)
    held = moved / np.sqrt(1 + unstable)
    out = [np.sort(np.array(pivot_columns(m.T @ m, count))) for m in (centred, moved, held)]
    return [a for k, a in enumerate(out) if not any(np.array_equal(a, b) for b in out[:k])]


def search_support(objective: MatchingObjective, active: np.ndarray, steps: int, rounds: int) -> list[tuple[str, Outcome, float]]:
    """What a search from one start finds, in order: the source, the candidate and its nuisance term."""
    width, uniform = objective.query.shape[1], np.full(len(active), 1 / len(active))
    out: list[tuple[str, Outcome, float]] = []

    def record(source: str, found: Outcome) -> Outcome:
        out.append((source, found, objective.terms(found.active, found.weights)[2]["nuisance"]))
        return found

    record("uniform", Outcome(active, uniform, objective(active, uniform)[0]))
    found = record("refit", projected_gradient(objective, active, uniform, steps=steps))
    if rounds and len(active) < width:
        found = record("exchange", exchange(objective, objective.full_gradient, found, rounds=rounds, entering=2))
        found = record("pursuit", pursue(objective, objective.full_gradient, found, width, rounds=1))
    record("polish", polish(objective, found))
    return out


def fit_support(rows: DataFrame, count: int = 256, beta: float = 0.002, steps: int = 150, rounds: int = 1, perturb=None, contrasts: bool = False) -> Fit:
    """Choose ``count`` columns and their weights from normal fit rows; the holdout picks among the pool.

    With ``contrasts`` the supports of :func:`contrast_starts` are tried too.
    """
    from fathom.operators.views import KINDS, perturbed

    fit_rows, held_rows = (rows.filter((F.col("role") == r) & (F.col("y") == 0)) for r in ("fit", "holdout"))
    if fit_rows.select("image_id").join(held_rows.select("image_id"), "image_id", "left_semi").limit(1).count():
        raise ValueError("fit and holdout share an image")
    ids, groups, x = local_rows(fit_rows)
    count = min(count, x.shape[1])
    # Variants of the sampled rows only: at most FIT_ROWS of each kind, in the order of ``x``.
    sampled = F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in ids.tolist()], rows.select("vec_id").schema))
    changed = (perturb or perturbed)(fit_rows.join(sampled, "vec_id", "left_semi")).select("vec_id", "kind", "w").orderBy("vec_id").toPandas() if beta else None
    nuisance = Nuisance(x, [np.array(changed[changed["kind"] == k]["w"].tolist()) for k in KINDS]) if beta else None
    tau = neighbours.temperature(fit_rows).first()["temperature"]
    gram = statistics.gram(fit_rows)
    moved = np.mean([((z - x) ** 2).mean(0) for z in nuisance.changed], axis=0) if beta else np.zeros(x.shape[1])
    supports = starts(gram, moved, count)
    supports += [a for a in contrast_starts(x, groups, moved / ((x * x).mean(0) + 1e-6), count) if not any(np.array_equal(a, b) for b in supports)] if contrasts else []
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast((x, groups, tau, nuisance, beta))

    def search(active: np.ndarray) -> list[tuple[str, Outcome, float]]:
        x, groups, tau, nuisance, beta = known.value
        return search_support(MatchingObjective(x, x, groups, groups, tau, nuisance, beta), active, steps, rounds)

    # The starts know nothing of each other: a task each.
    found = spark.sparkContext.parallelize(supports, len(supports)).map(search).collect()
    tried = [c for own in found for c in own]  # a few candidates a start
    pool = [{"id": k, "source": source, "active": o.active, "weights": o.weights, "loss": o.value, "nuisance": own} for k, (source, o, own) in enumerate(tried)]
    digest = frozen(pool)

    _, held_groups, held = local_rows(held_rows)
    judge = MatchingObjective(held, x, held_groups, groups, tau, None, 0.0)
    scores = [(judge(c["active"], c["weights"])[0] + beta * c["nuisance"], c["id"]) for c in pool]
    best = min(scores)[1]
    return Fit(pool[best]["active"], pool[best]["weights"], pool, digest, best, beta)


def fit_local_support(rows: DataFrame, count: int = 256, beta: float = 0.002, rank: int = 8, rank_weight: float = 1.0, rounds: int = 2, entering: int = 4, perturb=None) -> Fit:
    """Choose columns by the edges to the nearest and the ``rank``-th neighbour in other images.

    Supports start from the columns that move most along the edges, from the most energy, and from movement over
    nuisance; each is refitted and exchanged, and the holdout's edges pick among the frozen pool.
    """
    from fathom.operators.views import KINDS, perturbed

    fit_rows, held_rows = (rows.filter((F.col("role") == r) & (F.col("y") == 0)) for r in ("fit", "holdout"))
    if count < 1 or beta < 0 or rank_weight < 0:
        raise ValueError("the budget must be positive and the coefficients not negative")
    if fit_rows.select("image_id").join(held_rows.select("image_id"), "image_id", "left_semi").limit(1).count():
        raise ValueError("fit and holdout share an image")
    ids, _, x = local_rows(fit_rows)
    held_ids, _, held = local_rows(held_rows)
    count = min(count, x.shape[1])
    place = {i: k for k, i in enumerate(ids.tolist())}
    known = rows.sparkSession.createDataFrame([(i,) for i in ids.tolist()], rows.select("vec_id").schema)
    references = fit_rows.join(F.broadcast(known), "vec_id", "left_semi")  # at most FIT_ROWS ids

    def edges(queries: DataFrame, names: np.ndarray, own: np.ndarray, nuisance: Nuisance | None, weight: float) -> LocalObjective:
        asked = rows.sparkSession.createDataFrame([(i,) for i in names.tolist()], rows.select("vec_id").schema)
        found = neighbours.near_far(queries.join(F.broadcast(asked), "vec_id", "left_semi"), references, rank).select("query_id", "near_id", "far_id", "found").toPandas()
        if len(found) < len(names) or (found["found"] < 2).any():
            raise ValueError("a query has fewer than two references in other images")
        found = found.set_index("query_id").loc[names]
        near, far = (x[[place[i] for i in found[c].tolist()]] for c in ("near_id", "far_id"))
        return LocalObjective(own, near, far, nuisance, rank_weight, weight)

    changed = (perturb or perturbed)(references).select("vec_id", "kind", "w").orderBy("vec_id").toPandas() if beta else None
    nuisance = Nuisance(x, [np.array(changed[changed["kind"] == k]["w"].tolist()) for k in KINDS]) if beta else None
    objective, judge = edges(fit_rows, ids, x, nuisance, beta), edges(held_rows, held_ids, held, None, 0.0)
    energy = (x * x).mean(0)
    moved = (((x - objective.near) ** 2 + (x - objective.far) ** 2) * objective.weights[:, None]).mean(0) / 2
    unstable = np.mean([((z - x) ** 2).mean(0) for z in nuisance.changed], axis=0) / (energy + statistics.EPSILON) if beta else np.zeros(len(energy))
    scaled = lambda v: v / max(float(v.mean()), 1e-8)
    every = np.arange(x.shape[1])

    def full_gradient(active: np.ndarray, p: np.ndarray) -> np.ndarray:
        whole = np.zeros(len(every))
        whole[active] = p
        return objective(every, whole)[1]

    pool: list[dict] = []

    def record(source: str, found: Outcome) -> Outcome:
        own = beta * nuisance(found.active, found.weights)[0] if beta else 0.0
        pool.append({"id": len(pool), "source": source, "active": found.active, "weights": found.weights, "loss": found.value, "nuisance": own})
        return found

    for ranking in (scaled(moved) - beta * scaled(unstable), energy, moved / (1 + unstable)):
        active, uniform = np.sort(np.argsort(-ranking, kind="stable")[:count]), np.full(count, 1 / count)
        record("uniform", Outcome(active, uniform, objective(active, uniform)[0]))
        found = record("refit", projected_gradient(objective, active, uniform))
        if rounds and count < len(every):
            record("exchange", exchange(objective, full_gradient, found, rounds=rounds, entering=entering))
    digest = frozen(pool)
    best = min((judge(c["active"], c["weights"])[0] + c["nuisance"], c["id"]) for c in pool)[1]
    return Fit(pool[best]["active"], pool[best]["weights"], pool, digest, best)


def choose_normal_tail(rows: DataFrame, found: Fit, top: float = 0.01, tail: float = 0.25, multiplier: float = 1.0) -> tuple[int, DataFrame]:
    """The candidate of a frozen pool that spares the worst normal images most, and ``id, mean, mse, cvar`` of all.

    It must stay within ``multiplier`` clustered standard errors of the chosen one's holdout loss, and neither its
    squared error of image scores nor that error's upper ``tail`` mean may be above the chosen one's.  Nothing is refitted.
    """
    if frozen(found.pool) != found.digest:
        raise ValueError("the pool is not the one that was frozen")
    fit_rows, held = (rows.filter((F.col("role") == r) & (F.col("y") == 0)) for r in ("fit", "holdout"))
    if fit_rows.select("image_id").join(held.select("image_id"), "image_id", "left_semi").limit(1).count():
        raise ValueError("fit and holdout share an image")
    tau = neighbours.temperature(fit_rows).first()["temperature"]
    own = neighbours.nearest(fit_rows, fit_rows, 1, other_group=True).select(F.col("query_id").alias("vec_id"), (1 - F.col("cosine")).alias("distance"))
    fit_scores = neighbours.image_scores(fit_rows.select("vec_id", "image_id").join(own, "vec_id"), top)
    scale = fit_scores.agg(F.greatest(F.avg(F.col("score") * F.col("score")), F.lit(losses.FLOOR_SCALE))).first()[0]

    parts = [losses.matching_terms(held, fit_rows, c["active"], c["weights"], tau).withColumn("id", F.lit(int(c["id"]))) for c in found.pool]
    terms = functools.reduce(DataFrame.unionByName, parts).join(held.select(F.col("vec_id").alias("query_id"), "image_id"), "query_id").persist()
    weights = statistics.query_weights(terms.filter(F.col("id") == found.chosen).select("query_id", F.greatest(1 - F.col("best_teacher"), F.lit(0.0)).alias("distance")))
    w, dist, off = F.col("weight"), F.greatest(1 - F.col("best_teacher"), F.lit(0.0)), F.col("best_student") - F.col("best_teacher")
    weighted = terms.join(weights, "query_id")
    scales = weighted.filter(F.col("id") == found.chosen).agg(F.greatest(F.avg(w * (F.log("n") + F.col("entropy"))), F.lit(1e-6)).alias("a"), F.greatest(F.avg(w * dist * dist), F.lit(losses.FLOOR_SCALE)).alias("b")).first()
    loss = weighted.select("id", "image_id", (w * (F.col("entropy") - F.col("cross")) / scales["a"] + w * off * off / scales["b"]).alias("x"))
    se = statistics.cluster_standard_error(loss.filter(F.col("id") == found.chosen).select("x", "image_id"), "image_id").first()["se"]
    if se is None:
        raise ValueError("the holdout has fewer than two images")
    nuisance = rows.sparkSession.createDataFrame([(int(c["id"]), float(c["nuisance"]) * found.beta) for c in found.pool], "id int, nuisance double")
    mean = loss.groupBy("id").agg(F.avg("x").alias("x")).join(nuisance, "id").select("id", (F.col("x") + F.col("nuisance")).alias("mean"))

    keyed = terms.select(F.struct("id", "image_id").alias("image_id"), F.col("query_id").alias("vec_id"), "best_student", "best_teacher")
    scored = lambda c: neighbours.image_scores(keyed.select("image_id", "vec_id", (1 - F.col(c)).alias("distance")), top)
    both = scored("best_student").select("image_id", F.col("score").alias("s")).join(scored("best_teacher").select("image_id", F.col("score").alias("t")), "image_id")
    errors = both.select("image_id.id", ((F.col("s") - F.col("t")) * (F.col("s") - F.col("t")) / scale).alias("x"))
    candidates = mean.join(errors.groupBy("id").agg(F.avg("x").alias("mse")), "id").join(statistics.upper_tail_mean(errors, ["id"], tail), "id")
    table = rows.sparkSession.createDataFrame([tuple(r) for r in candidates.orderBy("id").collect()], candidates.schema)  # one row a candidate
    terms.unpersist()
    winner = selection.guarded_choice(table, F.lit(found.chosen), F.lit(float(se)), multiplier).first()["winner"]
    return int(winner), table


def fit_relation_support(rows: DataFrame, count: int = 256, beta: float = 0.002, k: int = 8, subsets: int = 8, votes: int = 5, seed: int = 42, rounds: int = 2, parents: int = 2, finalists: int = 4, perturb=None) -> Fit:
    """Choose columns by a vote-weighted graph of neighbours in other images.

    Supports start from the Laplacian score, from repeatability over halves, and from the score with correlated columns
    held down; the best are pursued, the best distinct ones frozen, and the holdout's graph picks among them.
    """
    from fathom.operators.views import KINDS, perturbed

    fit_rows, held_rows = (rows.filter((F.col("role") == r) & (F.col("y") == 0)) for r in ("fit", "holdout"))
    if fit_rows.select("image_id").join(held_rows.select("image_id"), "image_id", "left_semi").limit(1).count():
        raise ValueError("fit and holdout share an image")
    ids, groups, x = local_rows(fit_rows)
    held_ids, held_groups, held = local_rows(held_rows)
    width = x.shape[1]
    count = min(count, width)
    known = rows.sparkSession.createDataFrame([(i,) for i in ids.tolist()], rows.select("vec_id").schema)
    asked = rows.sparkSession.createDataFrame([(i,) for i in held_ids.tolist()], rows.select("vec_id").schema)
    references, judges = fit_rows.join(F.broadcast(known), "vec_id", "left_semi"), held_rows.join(F.broadcast(asked), "vec_id", "left_semi")
    parts = [np.sort(np.random.default_rng([seed, n]).choice(width, max(1, width // 2), replace=False)).tolist() for n in range(subsets)]
    tau = neighbours.temperature(references).first()["temperature"]
    place = {i: n for n, i in enumerate(ids.tolist())}

    def graph(queries: DataFrame, names: np.ndarray) -> tuple[DataFrame, np.ndarray]:
        edges = neighbours.stable_votes(queries, references, parts, k, votes).select("query_id", "ref_id", "weight")
        local = edges.toPandas()  # at most FIT_ROWS queries of k edges
        own, dense = {i: n for n, i in enumerate(names.tolist())}, np.zeros((len(names), len(ids)))
        dense[[own[i] for i in local["query_id"].tolist()], [place[i] for i in local["ref_id"].tolist()]] = local["weight"]
        if not dense.any():
            raise ValueError("no edge has enough votes")
        return edges, dense

    edges, dense = graph(references, ids)
    changed = (perturb or perturbed)(references).select("vec_id", "kind", "w").orderBy("vec_id").toPandas() if beta else None
    nuisance = Nuisance(x, [np.array(changed[changed["kind"] == n]["w"].tolist()) for n in KINDS]) if beta else None
    objective = RelationObjective(x, x, groups[:, None] != groups, dense, tau, nuisance, beta)
    column = lambda df, c: df.orderBy("j").toPandas()[c].to_numpy()  # noqa: E731  one row a column
    lap, repeat = column(statistics.laplacian_scores(references, edges), "score"), column(statistics.split_repeatability(references), "ratio")
    correlation = np.nan_to_num(np.corrcoef(x.T))
    every = np.arange(width)

    def full_gradient(active: np.ndarray, p: np.ndarray) -> np.ndarray:
        whole = np.zeros(width)
        whole[active] = p
        return objective(every, whole)[1]

    tried: list[Outcome] = []
    relevance = np.where(np.isfinite(lap), -lap, np.nanmin(-lap[np.isfinite(lap)], initial=0.0) - 1)
    for active in (np.argsort(lap, kind="stable")[:count], np.argsort(-repeat, kind="stable")[:count], np.array(relevant_columns(relevance, correlation, count))):
        tried.append(projected_gradient(objective, np.sort(active), np.full(count, 1 / count)))

    def best(many: int) -> list[Outcome]:
        own: dict[bytes, Outcome] = {}
        for o in sorted(tried, key=lambda o: o.value):
            own.setdefault(np.asarray(o.active).tobytes(), o)
        return list(own.values())[:many]

    if rounds and count < width:
        tried += [pursue(objective, full_gradient, parent, width, rounds=rounds) for parent in best(parents)]
    pool = []
    for o in best(finalists):
        pool.append({"id": len(pool), "source": "relation", "active": o.active, "weights": o.weights, "loss": o.value, "nuisance": nuisance(o.active, o.weights)[0] if beta else 0.0})
    digest = frozen(pool)
    judge = RelationObjective(held, x, held_groups[:, None] != groups, graph(judges, held_ids)[1], tau, None, 0.0)
    chosen = min((judge(c["active"], c["weights"])[0] + beta * c["nuisance"], c["id"]) for c in pool)[1]
    return Fit(pool[chosen]["active"], pool[chosen]["weights"], pool, digest, chosen, beta)


def fit_gram_support(rows: DataFrame, count: int, lambdas: np.ndarray, tolerance: float) -> tuple[np.ndarray, float]:
    """Quadratic objective: a path over ``lambdas``, each point cut to ``count`` columns and refitted."""
    h = statistics.squared_gram(statistics.gram(rows))
    best: tuple | None = None
    base = QuadraticObjective(h, np.zeros((len(h), 0)), 0.0)
    for lam, w in zip(lambdas, fista(base, lambdas).T, strict=True):
        q = QuadraticObjective(h, np.zeros((len(h), 0)), 0.0, float(lam))
        legacy = refit_columns(q, np.sort(np.argsort(-w, kind="stable")[:count]))
        pruned = refit_columns(q, np.flatnonzero(prune_columns(q, w, count) > 0))
        w = guarded(q, legacy, pruned)
        error, kept = q.error(w), int((w > 0).sum())
        rank = (0, kept, error) if error <= tolerance else (1, error, kept)
        if best is None or rank < best[0]:
            best = (rank, w, error)
    return best[1], best[2]


def fit_cosine_support(rows: DataFrame, count: int) -> Outcome:
    _, _, x = local_rows(rows)
    objective = CosineGramObjective(x, np.zeros((x.shape[1], 0)), 0.0)
    active = starts(statistics.gram(rows), np.zeros(x.shape[1]), count)[0]
    return projected_gradient(objective, active, np.full(count, 1 / count))


def fit_cosine_path(rows: DataFrame, variability: np.ndarray, sizes: list[int], tolerance: float = 0.05, beta: float = 0.002, first: np.ndarray | None = None, rounds: int = 2) -> tuple[dict, list[dict]]:
    """The Gram matrix of cosines over falling support sizes: the chosen point, and all points.

    From two starts (an earlier fit's weights ``first``, and the energies) the largest support is refitted and exchanged,
    then cut to the next size, and so on.  Chosen: within ``tolerance`` the fewest columns, then the least objective;
    if none is, the least error.
    """
    _, _, x = local_rows(rows)
    width = x.shape[1]
    sizes = sorted({min(n, width) for n in sizes}, reverse=True)
    if not sizes or sizes[-1] < 1 or not 0 <= tolerance <= 1:
        raise ValueError("sizes must be positive and the tolerance a share")
    objective, plain = CosineGramObjective(x, variability, beta), CosineGramObjective(x, variability[:, :0], 0.0)
    every = np.arange(width)

    def full_gradient(active: np.ndarray, p: np.ndarray) -> np.ndarray:
        whole = np.zeros(width)
        whole[active] = p
        return objective(every, whole)[1]

    path = []
    rankings = {"energy": (x * x).sum(0)} | ({"earlier": np.asarray(first, dtype=np.float64)} if first is not None else {})
    for source, ranking in rankings.items():
        active = np.sort(np.argsort(-ranking, kind="stable")[: sizes[0]])
        found = Outcome(active, np.full(len(active), 1 / len(active)), 0.0)
        for size in sizes:
            if size < len(found.active):
                found = prune_support(objective, found, size, onto_simplex)
            found = projected_gradient(objective, found.active, found.weights, onto_simplex)
            if rounds and size < width:
                found = exchange(objective, full_gradient, found, rounds=rounds, project=onto_simplex)
            error = float(np.sqrt(2 * max(plain(found.active, found.weights)[0], 0.0)))
            path.append({"source": source, "size": size, "active": found.active, "weights": found.weights, "objective": found.value, "error": error, "feasible": error <= tolerance})
    rank = lambda c: (0, c["size"], c["objective"]) if c["feasible"] else (1, c["error"], c["size"])
    return min(path, key=rank), path


def fit_layers(rows: DataFrame, layers: int, width: int, variability: np.ndarray, tolerance: float = 0.1, rule: str = "search") -> tuple[list[int], float, bool]:
    q = statistics.layer_inner_products(rows, layers, width)
    return choose_layers(q, gate_layers(q, variability), tolerance, rule=rule)


def build_memory(rows: DataFrame, method: Method, width: int, capacity: int = 20_000, seed: int = 42) -> DataFrame:
    """At most ``capacity`` represented rows; only normal training rows may enter."""
    wrong = rows.filter((F.col("role") != "fit") | (F.col("y") != 0)).limit(1).count()
    if wrong:
        raise ValueError("memory rows must be normal training rows")
    return represent(sampling.hashed_sample(rows, "vec_id", capacity, seed), method, width)


def evaluate(rows: DataFrame, methods: list[Method], width: int, fraction: float = 0.01, capacity: int = 20_000, threads: int = 4) -> DataFrame:
    """``method, positives, negatives, auroc, ap`` of image scores; methods run side by side."""
    tests, memory = rows.filter("role = 'test'"), rows.filter("role = 'fit' and y = 0")
    truth = tests.groupBy("image_id").agg(F.max("y").alias("y"))

    def scored(method: Method) -> DataFrame:
        found = neighbours.nearest(represent(tests, method, width), build_memory(memory, method, width, capacity))
        d = tests.select("vec_id", "image_id").join(found.select(F.col("query_id").alias("vec_id"), (1 - F.col("cosine")).alias("distance")), "vec_id")
        return neighbours.image_scores(d, fraction).join(truth, "image_id").select(F.lit(method.name).alias("method"), "image_id", "y", F.col("score").alias("s"))

    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(scored, methods))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return metrics.ranking_metrics(whole, ["method"])


def run_tasks(spark: SparkSession, tasks: list, job, threads: int = 4) -> list:
    """Run the first task alone as a gate, then the others in fair scheduler pools."""
    first = job(tasks[0])

    def pooled(item):
        k, task = item
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"task{k % threads}")
        return job(task)

    with ThreadPoolExecutor(threads) as pool:
        return [first, *pool.map(pooled, enumerate(tasks[1:]))]
