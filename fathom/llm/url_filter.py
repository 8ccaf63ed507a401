"""URL filtering: listed rules first, then gradient-boosted trees on lexical features.

Everything is DataFrame work.  The trees are grown from histograms: a level of a tree is one grouped
sum of gradients and curvatures by (node, feature, bin) over the labelled sample, and the finished
model is one nested CASE expression inside the scan's generated code.  Gradients are summed as
integers, so reruns grow the same trees.

Labels: by default a URL is a labelled bad one if its host holds a word of ``BAD_WORDS``, and a
labelled good one if it does not and no block rule fits it; any other boolean column can be given.
The model sees lexical features only: lengths, depth, digit ratio, entropy, parameter counts, host
shape, and statistics of the host's suffixes among the labelled URLs; a labelled URL's own label takes no
part in the statistics that it is learned with.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by the trees; repeated rows are judged alike and a repeated URL is learned once; of rules of one
length that fit, the one listed last wins; with no labelled URLs of both kinds every URL without a rule is
allowed; a url may be of any length; an empty table gives an empty result; columns besides ``page_id`` and
``url`` are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import materialize

#: (verdict, host, path prefix), unless a caller lists others, as the registered query does
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BAD_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "viagra")
#: Labelled rows the trees are grown on, and suffixes that get statistics of their own.
LABELLED_ROWS, SUFFIXES = 20_000, 256
ROUNDS, DEPTH, BINS, RATE, RIDGE = 10, 3, 16, 0.4, 1.0
_SCALE = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """``host`` (A-Z lower-cased) and ``path`` of ``url``."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    out = pages.withColumn("_after", F.coalesce(after, F.lit("")))
    out = out.withColumn("_host", F.regexp_extract("_after", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_after, length(_host) + 1)"), r"^[^?#]*", 0)
    return out.withColumn("path", path).withColumn("host", F.translate("_host", _UPPER, _LOWER))


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _count(text: str, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(F.expr(text), F.lit(pattern)), F.lit(0)).cast("double")


def _entropy(text: str) -> Column:
    """Shannon entropy of the characters, in bits."""
    return F.expr(
        f"coalesce(aggregate(array_distinct(filter(split({text}, ''), c -> c <> '')), 0D, (acc, c) -> acc - "
        f"((length({text}) - length(replace({text}, c, ''))) / length({text})) * log2((length({text}) - length(replace({text}, c, ''))) / length({text}))), 0D)"
    )


def features() -> dict[str, Column]:
    query = "coalesce(regexp_extract(_after, '[?]([^#]*)', 1), '')"
    return {
        "url_length": F.coalesce(F.length("url"), F.lit(0)).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": _count("path", "/+[^/]"),
        "host_labels": _count("host", "[^.]+"),
        "host_hyphens": _count("host", "-"),
        "host_digits": _count("host", "[0-9]"),
        "digit_ratio": _count("coalesce(url, '')", "[0-9]") / F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1)),
        "host_entropy": _entropy("host"),
        "path_entropy": _entropy("path"),
        "parameters": F.when(F.length(F.expr(query)) > 0, _count(query, "&") + 1).otherwise(F.lit(0.0)),
        "query_length": F.length(F.expr(query)).cast("double"),
    }


#: The keys of :func:`features`.
_LEXICAL = (
    "url_length", "host_length", "path_length", "depth", "host_labels", "host_hyphens", "host_digits", "digit_ratio",
    "host_entropy", "path_entropy", "parameters", "query_length",
)
_SUFFIX = {"suffix1": r"[^.]+$", "suffix2": r"[^.]+\.[^.]+$"}
_STATS = ("rate", "frequency")
NAMES = [*_LEXICAL, *(f"{s}_{k}" for s in _SUFFIX for k in _STATS)]


def _lexical(pages: DataFrame) -> DataFrame:
    return pages.withColumns(features() | {s: F.regexp_extract("host", p, 0) for s, p in _SUFFIX.items()})


@dataclass
class Model:
    """Suffix statistics (a few hundred rows) and trees: lists of ``(feature, threshold, left, right)`` or leaf values."""

    suffixes: dict[str, list[tuple[str, int, int]]]
    rows: int
    rate: float
    start: float
    trees: list

    def with_suffixes(self, rows: DataFrame, own: bool = False) -> DataFrame:
        """``rows`` with the statistics of their suffixes; with ``own`` the rows are learned from, and each is left out of its own."""
        for s, known in self.suffixes.items():
            small = rows.sparkSession.createDataFrame(known or [("", 0, 0)], f"{s} string, _n long, _bad long")
            rows = rows.join(F.broadcast(small), s, "left").fillna({"_n": 0, "_bad": 0})
            n, bad = F.col("_n"), F.col("_bad")
            if own:
                n, bad = F.greatest(n - 1, F.lit(0)), F.greatest(bad - F.col("bad").cast("long"), F.lit(0))
            rate = (bad + 20 * self.rate) / (n + 20)
            rows = rows.withColumns({f"{s}_rate": rate, f"{s}_frequency": F.log1p(F.col("_n") * 1000 / max(self.rows, 1))}).drop("_n", "_bad")
        return rows

    def score(self) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + _tree_value(tree)
        return total


def _tree_value(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, threshold, left, right = node
    return F.when(F.col(feature) <= F.lit(threshold), _tree_value(left)).otherwise(_tree_value(right))


def fit(labelled: DataFrame) -> Model:
    """Grow the trees on at most ``LABELLED_ROWS`` distinct rows of ``labelled(url, host, path, _after, bad)``."""
    near = labelled.select("url", "host", "path", "_after", "bad")
    total = near.count()
    if total > 2 * LABELLED_ROWS:  # about twice the wanted rows; their features are computed for the chosen ones only
        near = near.filter(F.xxhash64("url") <= F.lit(-(1 << 63) + (1 << 64) * 2 * LABELLED_ROWS // total))
    chosen = near.distinct().orderBy(F.xxhash64("url"), "url", "bad").limit(LABELLED_ROWS)
    rows = materialize(_lexical(chosen).select("bad", *_LEXICAL, *_SUFFIX), "url-labelled")
    count = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).alias("bad")).first()
    n, bad = count["n"], count["bad"]
    if not bad or bad == n:
        return Model({s: [] for s in _SUFFIX}, n, 0.0, -1.0, [])
    rate = bad / n
    suffixes = {}
    for s in _SUFFIX:
        top = rows.groupBy(s).agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad")).orderBy(F.desc("n"), s).limit(SUFFIXES).collect()
        suffixes[s] = [(r[s], r["n"], r["bad"]) for r in top]
    model = Model(suffixes, n, rate, 0.0, [])
    rows = model.with_suffixes(rows, own=True).select("bad", *NAMES)

    cuts = rows.select(*(F.percentile_approx(name, [k / BINS for k in range(1, BINS)], 10_000).alias(name) for name in NAMES)).first()
    edges = {name: sorted(set(cuts[name])) for name in NAMES}
    bins = [sum((F.when(F.col(name) > e, 1).otherwise(0) for e in edges[name]), F.lit(0)).alias(f"b_{name}") for name in NAMES]
    # Both kinds weigh the same, whatever their numbers.
    weight = F.when(F.col("bad"), F.lit(0.5 / rate)).otherwise(F.lit(0.5 / (1 - rate))).alias("weight")
    rows = materialize(rows.select("bad", weight, *NAMES, *bins), "url-binned")

    for _ in range(ROUNDS):
        chance = 1 / (1 + F.exp(-model.score()))
        grads = rows.withColumn("chance", chance).select(
            *NAMES,
            F.array(*(f"b_{name}" for name in NAMES)).alias("bins"),
            F.round((F.col("chance") - F.col("bad").cast("double")) * F.col("weight") * _SCALE).cast("long").alias("g"),
            F.round(F.col("chance") * (1 - F.col("chance")) * F.col("weight") * _SCALE).cast("long").alias("h"),
        )
        model.trees.append(_grow(grads, edges))
    return model


def _grow(grads: DataFrame, edges: dict[str, list[float]]):
    """One tree: at each level one grouped sum, at most nodes x features x bins rows."""
    splits: dict[int, tuple[str, float]] = {}
    values: dict[int, float] = {}

    def place(node: int, depth: int) -> Column:
        if depth == 0 or node not in splits:
            return F.lit(node)
        name, threshold = splits[node]
        return F.when(F.col(name) <= F.lit(threshold), place(2 * node, depth - 1)).otherwise(place(2 * node + 1, depth - 1))

    for depth in range(DEPTH):
        at = grads.select(place(1, depth).alias("node"), "g", "h", F.posexplode("bins").alias("feature", "bin"))
        sums = at.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        by: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for r in sums:
            by.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"] / _SCALE, r["h"] / _SCALE)
        for node, per_feature in by.items():
            if node in values and node not in splits and node < 1 << depth:
                continue
            whole = per_feature[0]
            g, h = sum(v[0] for v in whole.values()), sum(v[1] for v in whole.values())
            values[node] = -RATE * g / (h + RIDGE)
            best = None
            for f, name in enumerate(NAMES):
                gl = hl = 0.0
                for b, edge in enumerate(edges[name]):
                    add = per_feature.get(f, {}).get(b, (0.0, 0.0))
                    gl, hl = gl + add[0], hl + add[1]
                    if hl < 1 or h - hl < 1:
                        continue
                    gain = round(gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE), 6)
                    if gain > 1e-3 and (best is None or gain > best[0]):
                        best = (gain, name, edge, gl, hl)
            if best:
                _, name, edge, gl, hl = best
                splits[node] = (name, float(edge))
                values[2 * node] = -RATE * gl / (hl + RIDGE)
                values[2 * node + 1] = -RATE * (g - gl) / (h - hl + RIDGE)

    def tree(node: int):
        if node not in splits:
            return values.get(node, 0.0)
        return (*splits[node], tree(2 * node), tree(2 * node + 1))

    return tree(1)


def _says_bad() -> Column:
    return F.arrays_overlap(F.split("host", "[.-]"), F.array(*(F.lit(w) for w in BAD_WORDS)))


def judge_urls(pages: DataFrame, rules=RULES, bad: Column | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row of ``pages(page_id, url, ...)``.

    ``bad``: a boolean column over ``url``, ``host`` and ``path`` that labels URLs, null for unlabelled ones.
    """
    rule, verdict = fitting_rule(rules)
    parts = with_parts(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("said", verdict)
    if bad is None:
        bad = F.when(_says_bad(), True).when(F.col("said").isNull() | (F.col("said") == "allow"), False)
    labelled = parts.filter("host <> ''").withColumn("bad", bad).filter("bad is not null")
    model = fit(labelled)
    scored = model.with_suffixes(_lexical(parts)).withColumn("score", 1 / (1 + F.exp(-model.score())))
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", by_trees).alias("verdict"), "score")
