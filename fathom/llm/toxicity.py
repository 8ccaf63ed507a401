"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings is trained in numpy from confirmed toxic
documents and unlabelled text only.  The risk is corrected by the class prior p::

    p * E_toxic[loss(f)] + max(0, E_unlabelled[loss(-f)] - p * E_toxic[loss(-f)])

and whenever the bracket falls below zero the step goes against it alone, so the model cannot profit
from unlabelled documents that it has merely learned by heart.  Known clean labels enter only through
the prior, the toxic share of all labelled training rows.

Only rows outside the held-out fifth (crc32 of the id as text, modulo 5, is 0) lend labels.  Scores
depend on the text alone.  Whole texts are scored in one vectorised pass.

Defined results: null and empty texts get the score of a text without any feature; repeated rows score
alike; with no toxic training row every score is the prior; a null id counts as the empty string for the
held-out fifth and lends no label; of texts that share an id the one of least hash is learned from; an id
with several labels is toxic if any says so; a text may be of any length; an empty table gives an empty
result; columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import frugal, least_hashed, small_batches
from fathom.llm.shingles import _U64, _power_table, mix, slices, utf8_parts

#: Documents the model is fitted on: confirmed toxic ones and unlabelled ones.
TOXIC_ROWS, UNLABELLED_ROWS = 4_000, 12_000
HASH_BITS = 22
#: Lengths in bytes of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6, 7)
#: A feature takes part if at least so many toxic documents have it, and if the (bounded) chance that so many
#: would have it at its unlabelled rate is no more than this, and if by the prior at least this share of the
#: unlabelled documents with it is toxic.
MIN_TOXIC, MAX_CHANCE, MIN_PURITY, MAX_FEATURES = 3, 1e-6, 0.5, 1_024
#: Beyond features of this share of the toxic documents, one takes part only for what others leave uncovered.
MIN_SHARE = 0.02
STEPS, RATE, RIDGE = 400, 0.1, 1e-4

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _features(column: pa.Array, wanted: np.ndarray | None = None):
    """``(first row, number of rows, rows, feature)`` for stretches of rows: distinct hashed features of each row.

    With ``wanted`` (a mask over the hash range) only those features are looked at.
    """
    low = pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())
    raw, offsets = utf8_parts(low)
    for first, last in slices(offsets):
        base, end = int(offsets[first]), int(offsets[last])
        data, size = raw[base:end], end - base
        inside = _LETTER[data]
        cut = np.zeros(size + 1, dtype=bool)
        cut[offsets[first : last + 1] - base] = True
        starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | cut[:-1]))
        ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | cut[1:])) + 1
        up, down = _power_table(size + 1)
        row = np.searchsorted(offsets[first : last + 1] - base, starts, side="right") - 1
        keys = []
        with np.errstate(over="ignore"):
            running = np.zeros(size + 1, dtype=_U64)
            np.cumsum((data.astype(_U64) + _U64(1)) * up[:size], out=running[1:])
            for length in (0, *BEGINNINGS):
                long = slice(None) if not length else np.flatnonzero(ends - starts > length)
                s = starts[long]
                e = s + length if length else ends
                h = mix((running[e] - running[s]) * down[s] + _U64(length) * _U64(0x9E3779B97F4A7C15))
                feature = (h >> _U64(64 - HASH_BITS)).astype(np.int64)
                r = row[long]
                if wanted is not None:
                    keep = wanted[feature]
                    feature, r = feature[keep], r[keep]
                keys.append((r << HASH_BITS) | feature)
        both = np.unique(np.concatenate(keys))
        yield first, last - first, both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __getstate__(self) -> tuple:
        """Few weights are not zero, and only those travel."""
        at = np.flatnonzero(self.weights)
        return len(self.weights), at, self.weights[at], self.bias

    def __setstate__(self, state: tuple) -> None:
        many, at, found, self.bias = state
        self.weights = np.zeros(many, dtype=found.dtype)
        self.weights[at] = found

    def scores(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.bias)
        for first, _, rows, feature in _features(column, self.weights != 0):
            if len(rows):
                part = np.bincount(rows, weights=self.weights[feature])
                total[first : first + len(part)] += part
        return 1 / (1 + np.exp(-total))


def _placed(names: np.ndarray, side: list[np.ndarray]) -> list[np.ndarray]:
    """For each document the positions of its features among the sorted ``names``."""
    out = []
    for x in side:
        at = np.searchsorted(names, x)
        at[at == len(names)] = 0
        out.append(at[names[at] == x] if len(names) else np.zeros(0, dtype=np.int64))
    return out


def _evidence(found: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Chernoff's bound of a Poisson tail, as a negative logarithm."""
    k = np.maximum(found, 1)
    return np.where(found > expected, expected - k * (1 + np.log(expected / k)), 0.0)


def _chosen(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """Features that speak for toxicity: frequent ones, and then such as cover what is left.

    Copies of one toxic document share all their rare words.  Once a feature covers them, those words have
    nothing left to explain, so they do not take part.
    """
    n_t, n_u = len(toxic), len(unlabelled)
    names, found = np.unique(np.concatenate(toxic), return_counts=True)
    names, found = names[found >= MIN_TOXIC], found[found >= MIN_TOXIC]
    if not len(names):
        return names
    common = np.zeros(len(names))
    for at in _placed(names, unlabelled):
        common[at] += 1
    rate = (common + 0.5) / (n_u + 1)
    enough = -np.log(MAX_CHANCE)
    able = (prior * found >= MIN_PURITY * n_t * rate) & (_evidence(found, n_t * rate) >= enough)
    names, found, rate = names[able], found[able], rate[able]
    own = _placed(names, toxic)
    having: list[list[int]] = [[] for _ in names]
    for d, features in enumerate(own):
        for f in features.tolist():
            having[f].append(d)
    open_docs = np.ones(n_t, dtype=bool)
    left = found.astype(np.float64)
    picked: list[int] = []
    while len(picked) < MAX_FEATURES and len(names):
        score = _evidence(left, max(open_docs.sum(), 1) * rate)
        score[(left < MIN_TOXIC) | (score < enough)] = 0
        best = int(np.argmax(score))
        if not score[best]:
            break
        picked.append(best)
        for d in having[best]:
            if open_docs[d]:
                open_docs[d] = False
                left[own[d]] -= 1
    often = np.flatnonzero(found >= MIN_SHARE * n_t)
    often = often[np.argsort(-found[often], kind="stable")[:MAX_FEATURES]]
    return names[np.union1d(np.array(picked, dtype=np.int64), often).astype(np.int64)]


def train(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Fit on lists of distinct feature arrays."""
    prior = min(max(prior, 1e-3), 0.999)
    weights = np.zeros(1 << HASH_BITS, dtype=np.float32)
    start = float(np.log(prior / (1 - prior)))
    if not toxic or not unlabelled:
        return Model(weights, start)
    chosen = _chosen(toxic, unlabelled, prior)
    placed = [_placed(chosen, side) for side in (toxic, unlabelled)]
    # Labels may be drawn with more toxic documents than there are.  The share of unlabelled documents that
    # the features reach, over the share of toxic ones, is what the unlabelled text allows at most.
    reached = [np.mean([len(x) > 0 for x in side]) for side in placed]
    if reached[0] > 0.25:
        prior = min(prior, max(float(reached[1] / reached[0]), 1e-3))
        start = float(np.log(prior / (1 - prior)))

    sides = [(np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate(side).astype(np.int64), len(side)) for side in placed]
    n_t, n_u = len(toxic), len(unlabelled)
    w, b = np.zeros(len(chosen)), start
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    softplus = lambda z: np.logaddexp(0, z)

    for step in range(1, STEPS + 1):
        f_t, f_u = (b + np.bincount(r, weights=w[c], minlength=n) for r, c, n in sides)
        negative = softplus(f_u).mean() - prior * softplus(f_t).mean()
        s_t, s_u = 1 / (1 + np.exp(-f_t)), 1 / (1 + np.exp(-f_u))
        # Derivatives of the mean losses by each document's output.
        as_clean_u, as_clean_t, as_toxic_t = s_u / n_u, prior * s_t / n_t, prior * (s_t - 1) / n_t
        d_t, d_u = (as_toxic_t - as_clean_t, as_clean_u) if negative >= 0 else (as_clean_t, -as_clean_u)
        grad = np.zeros(len(chosen) + 1)
        for (r, c, _), d in zip(sides, (d_t, d_u), strict=True):
            grad[:-1] += np.bincount(c, weights=d[r], minlength=len(chosen))
            grad[-1] += d.sum()
        grad[:-1] += RIDGE * w
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0.0), b - move[-1]
    weights[chosen] = w
    return Model(weights, float(b))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """Fit on the documents whose hashed ids are least: confirmed toxic ones, and any others."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    ids = docs.select("doc_id").filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).distinct()
    bad = known.filter("toxic = 1").select("doc_id")
    sizes = ids.agg(F.count("*").alias("ids")).crossJoin(bad.agg(F.count("*").alias("bad"))).first()
    confirmed = least_hashed(ids.join(bad, "doc_id", "left_semi"), ["doc_id"], toxic_rows, sizes["bad"]).withColumn("toxic", F.lit(True))
    others = least_hashed(ids, ["doc_id"], unlabelled_rows, sizes["ids"]).withColumn("toxic", F.lit(False))
    sample = F.broadcast(confirmed.unionByName(others))  # at most toxic_rows + unlabelled_rows ids

    def extract(batches):
        for batch in frugal(batches):
            out: list[list] = [[], []]
            flags = batch.column(1).to_pylist()
            for first, many, rows, feature in _features(batch.column(0)):
                for r, part in enumerate(np.split(feature, np.searchsorted(rows, np.arange(1, many)))):
                    out[0].append(flags[first + r])
                    out[1].append(part.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.bool_()), pa.array(out[1], pa.binary())], names=["toxic", "features"])

    # One text an id, so that the rows are no more than the ids drawn.
    texts = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = texts.select("text", "toxic").mapInArrow(extract, "toxic boolean, features binary")
    with small_batches(docs.sparkSession):
        found = sorted((r["toxic"], bytes(r["features"])) for r in found.toLocalIterator())
    sides = [[np.frombuffer(packed, dtype=np.uint32) for toxic, packed in found if toxic == side] for side in (True, False)]
    return train(*sides, prior if prior is not None else 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row, the score between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in frugal(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text, ...)``."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the model calls toxic; columns of any name and type stay as they are.

    A model that has learned nothing (no toxic label, or no feature that tells) rejects nothing.
    """
    model = fit(docs, labels)
    if not np.any(model.weights):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in frugal(batches):
            found = shared.value.scores(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(found < 0.5))

    return docs.mapInArrow(run, docs.schema)
