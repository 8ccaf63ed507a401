"""Mixing sources to target weights along a time-varying curriculum.

A source's weight over training time is a piecewise-linear schedule; its integral up to time ``t``
is the source's cumulative token demand, scaled so that the whole schedule asks for the source's
target.  Documents of a source stand in a fixed hashed order; the running sum of their sizes is the
supply.  Inverting the demand at a document's place in the supply gives its training position, and
the mix is range-sorted by position.  A target beyond the source's size starts a second pass over
the same order, with training positions of its own; the document at which the demand ends is taken in part.

Running sums never gather a source in one task: documents are summed by (source, hash bucket) first,
and only the sums of the 4096 buckets are accumulated.  Rows that nothing tells apart are one counted
run until the end, so any number of them is one row in a running sum.

Defined results: null and wordless texts have size 0, no position and are not taken; documents without a
source form the last source; rows without an id stand in the order of their text's hash; repeated rows
are separate documents, one behind the other; documents of one hash stand in the order of their id, size
and text hash; a text may be of any length; an empty table gives an empty mix; extra columns of any name
and type are kept as they are by :func:`mixed_texts` and not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import hash_bucket_totals, materialize, partitions, placed_in_order

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix has this many times the words of all documents, a source at most twice its own.
TOTAL, MOST = 1.5, 2
#: Cells in which words are counted before training is cut into stretches.
CELLS = 4096
#: What a row needs to know of its source.
OF_SOURCE = ("place", "source_size", "target", "wanted")
#: Weight schedule ``(time, weight)`` for each source in turn: early, level, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def _demand_pieces(schedule) -> list[tuple[float, float, float, float]]:
    """``(start, width, share before, shares of the linear and the square part)`` of the integral."""
    total = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(schedule, schedule[1:], strict=False))
    out, before = [], 0.0
    for (a, u), (b, v) in zip(schedule, schedule[1:], strict=False):
        out.append((a, b - a, before, u / total, (v - u) / (b - a) / total))
        before += (b - a) * (u + v) / 2 / total
    return out


def inverted_demand(share: Column, schedule) -> Column:
    """The time at which the schedule's integral reaches ``share`` (0 to 1) of its total."""
    found = F.lit(float(schedule[-1][0]))
    for start, width, before, rate, slope in reversed(_demand_pieces(schedule)):
        need = share - F.lit(before)
        # rate * x + slope / 2 * x * x = need, in the form that stays exact when slope is 0
        x = 2 * need / (F.lit(rate) + F.sqrt(F.greatest(F.lit(rate * rate) + 2 * F.lit(slope) * need, F.lit(0.0))))
        inside = share <= F.lit(before + rate * width + slope / 2 * width * width)
        found = F.when(inside, F.lit(start) + F.coalesce(x, F.lit(0.0))).otherwise(found)
    return found


def _weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources in code point order, null last, with their weights in turn."""
    keyed = sources.withColumn("unnamed", F.col("source").isNull())
    placed = placed_in_order(keyed, ["unnamed", "source"], "place", "mixing-order").drop("unnamed")
    return placed.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """``(source, source_size, place, target)`` from ``sizes(source, size)``.

    Each source gets its weight's share of ``total`` times all sizes; whoever passes ``most`` times its
    own size stops there, and the rest is shared again among the others until none is above.
    """
    sources = materialize(_weighted(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mixing-sources")
    whole = total * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:
        cap = F.lit(most) * F.col("source_size")
        stopped = F.lit(False) if level is None else cap <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(stopped, cap)).alias("full"), F.sum(F.when(~stopped, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        now = (whole - (row["full"] or 0)) / row["open"]
        if now == level:
            break
        level = now
    target = (F.lit(most) * F.col("source_size")).cast("double")
    if level is not None:
        target = F.least(target, F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", "place", target.alias("target"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _order() -> Column:
    """A fixed scattered order of documents; rows without an id are scattered by their texts."""
    unnamed = F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), unnamed))


def _mark() -> Column:
    """Tells texts of one size under a repeated id apart."""
    return F.xxhash64("text")


def _key() -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))


def _placed(docs: DataFrame, weights: tuple[float, ...], total: float, most: int) -> DataFrame:
    """Documents without their texts, with their source's target and the supply ``before`` them.

    Rows that nothing tells apart are one row with their number ``many``.
    """
    same = ["source", "order", "doc_id", "size", "mark"]
    sized = docs.select("doc_id", "source", _size().alias("size"), _order().alias("order"), _mark().alias("mark"))
    sized = sized.groupBy(*same).agg(F.count("*").alias("many"))
    sized = materialize(sized.withColumn("bucket", F.substring("order", 1, 3)).withColumn("words", F.col("many") * F.col("size")), "mixing-sizes")
    targets = source_targets(sized.select("source", F.col("words").alias("size")), weights, total, most)

    keyed = sized.withColumn("key", _key())
    before = hash_bucket_totals(keyed, "key", "bucket", "words").select("key", "bucket", "before_bucket")
    earlier = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(before, ["key", "bucket"]).withColumn("before", F.col("before_bucket") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    known = targets.select(_key().alias("key"), "source_size", "place", "target")
    return placed.join(known, "key").withColumn("wanted", F.round("target").cast("long"))


def _position(before: Column, schedules) -> Column:
    """Training position of what its source has ``before`` words of demand ahead of."""
    share = before / F.greatest(F.col("target"), F.lit(1.0))
    position = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        position = F.when(F.col("place") % len(schedules) == k, inverted_demand(share, schedule)).otherwise(position)
    return position


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """Every document's ``doc_id, source, size, source_size, target, taken, first_pass, later_passes, words, positions, position``.

    ``taken`` counts its words over all passes.  ``words[k]`` are those that pass ``k`` takes, and
    ``positions[k]`` (0 to 1) is where the first of them stands in training, null if the pass takes none;
    ``position`` is that of the first pass.  Rows come range-sorted by it, those that are not taken first.
    """
    placed = _placed(docs, weights, total, most)
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    copies = copies.withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    ahead = [F.col("before") + k * F.col("source_size") for k in range(most)]
    words = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("wanted") - a)).cast("long") for a in ahead]
    places = [F.when(w > 0, _position(a, schedules)) for a, w in zip(ahead, words, strict=True)]
    out = copies.select(
        "doc_id", "source", "size", "source_size", "target", sum(words[1:], words[0]).alias("taken"), words[0].alias("first_pass"), sum(words[1:], F.lit(0).cast("long")).alias("later_passes"), F.array(*words).alias("words"), F.array(*places).alias("positions"), places[0].alias("position")
    )
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def _runs(placed: DataFrame, most: int, schedules) -> DataFrame:
    """For each pass and each row of :func:`_placed`: its words and where it starts and ends."""
    runs = placed.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn"))
    ahead = F.col("before") + F.col("turn") * F.col("source_size")
    words = F.least(F.col("words"), F.col("wanted") - ahead)
    last = ahead + F.floor((words - 1) / F.col("size")) * F.col("size")
    at = F.struct("order", "doc_id", "size", "mark").alias("at")
    return runs.select("key", "turn", *OF_SOURCE, at, "before", words.alias("words"), _position(ahead, schedules).alias("first"), _position(last, schedules).alias("last")).filter("words > 0")


def _cuts(runs: DataFrame, slices: int, schedules) -> list[float]:
    """At most ``slices - 1`` positions that cut training into stretches of about as many words, and no run in two."""
    low, high = min(s[0][0] for s in schedules), max(s[-1][0] for s in schedules)
    cell = F.floor((F.col("first") - F.lit(low)) / F.lit((high - low) / CELLS)).cast("int").alias("cell")
    sums = sorted((r["cell"], r["words"]) for r in runs.groupBy(cell).agg(F.sum("words").alias("words")).collect())  # at most CELLS + 1 rows
    each, seen, cuts = sum(w for _, w in sums) / slices, 0, []
    for number, words in sums:
        if seen >= each * (len(cuts) + 1):
            cuts.append(low + number * (high - low) / CELLS)
        seen += words
    long = runs.filter("last > first").select("first", "last")
    while cuts:
        known = F.broadcast(runs.sparkSession.createDataFrame([(c,) for c in cuts], "cut double"))
        inside = long.join(known, (F.col("first") < F.col("cut")) & (F.col("cut") <= F.col("last"))).groupBy("cut").agg(F.max("last").alias("last")).collect()
        if not inside:
            break
        moved = {r["cut"]: math.nextafter(r["last"], math.inf) for r in inside}
        cuts = sorted({moved.get(c, c) for c in cuts})
    return cuts


def mixed_texts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass that takes a document, range-sorted by
    the row's training position.

    Positions grow with a source's hashed order, so a stretch of training is one stretch of that order in each
    source and pass.  Where those start is a small table, from which the texts are dealt to their stretch at once;
    there a running sum gives each row its supply and position.  A document that a pass takes in part keeps its
    first words, joined by single spaces.  ``n_chars``, where there is such a column, follows the text.
    Documents without any word are not taken.
    """
    slices = partitions(docs.sparkSession)
    runs = materialize(_runs(_placed(docs, weights, total, most), most, schedules), "mixing-runs")
    cuts = F.array(*(F.lit(c) for c in _cuts(runs, slices, schedules))).cast("array<double>")
    runs = runs.withColumn("slice", F.size(F.filter(cuts, lambda c: c <= F.col("first"))))
    starts = runs.groupBy("key", "turn", "slice").agg(F.min(F.struct("at", "before")).alias("start"), F.max("at").alias("stop"), *(F.first(c).alias(c) for c in OF_SOURCE))
    # One row a source and pass, of at most ``slices`` starts; its size decides how it is joined.
    known = starts.groupBy("key", "turn").agg(F.sort_array(F.collect_list(F.struct("start.at", "slice", "start.before"))).alias("starts"), F.max("stop").alias("stop"), *(F.first(c).alias(c) for c in OF_SOURCE))
    known = materialize(known, "mixing-starts")

    # The documents' own columns travel in one struct, so that no name of theirs can clash.
    own = docs.select(F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("row"), _size().alias("size"), _order().alias("order"), _mark().alias("mark"), "doc_id", _key().alias("key")).filter("size > 0")
    own = own.join(known, "key").withColumn("at", F.struct("order", "doc_id", "size", "mark")).filter("at <= stop")
    own = own.withColumn("start", F.element_at(F.filter("starts", lambda s: s["at"] <= F.col("at")), -1)).drop("starts", "stop")
    own = own.withColumn("slice", F.col("start.slice")).repartitionById(slices, "slice")
    earlier = Window.partitionBy("slice", "key", "turn").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("start.before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.col("turn") * F.col("source_size")
    taken = own.withColumn("ahead", ahead).withColumn("words", F.least(F.col("size"), F.col("wanted") - F.col("ahead"))).filter("words > 0")
    taken = taken.withColumn("position", _position(F.col("ahead"), schedules)).sortWithinPartitions("position", "doc_id")
    text = F.col("row").getField("text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    partly = F.col("words") < F.col("size")
    columns = []
    for name in docs.columns:
        same = F.col("row").getField(name)
        if name == "text":
            same = F.when(partly, cut).otherwise(same)
        elif name == "n_chars":
            same = F.when(partly, F.length(cut)).otherwise(same).cast(docs.schema["n_chars"].dataType)
        columns.append(same.alias(name))
    return taken.select(*columns)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))) AS ord
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place,
         (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS whole,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM sources
), levels AS (
  SELECT max((whole - full_before) / open_weight) AS level FROM ranked
  WHERE 2 * source_size > (whole - full_before) / open_weight * weight
), targets AS (
  SELECT source, source_size, place, CASE WHEN level IS NULL THEN 2.0 * source_size ELSE least((2 * source_size)::DOUBLE, level * weight) END AS target
  FROM ranked CROSS JOIN levels
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.place, t.target, round(t.target)::BIGINT AS wanted,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), turns AS (
  SELECT *, before / greatest(target, 1.0) AS share, (before + source_size) / greatest(target, 1.0) AS next_share FROM placed
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, wanted - before)) + greatest(0, least(size, wanted - before - source_size)))::BIGINT AS taken,
       CASE WHEN least(size, wanted - before) > 0 THEN round(CASE place % 3
         WHEN 0 THEN 2 * share / (1.5 + sqrt(2.25 - 2 * share)) WHEN 1 THEN share ELSE 2 * share / (0.5 + sqrt(0.25 + 2 * share)) END, 9) END AS position,
       CASE WHEN least(size, wanted - before - source_size) > 0 THEN round(CASE place % 3
         WHEN 0 THEN 2 * next_share / (1.5 + sqrt(2.25 - 2 * next_share)) WHEN 1 THEN next_share ELSE 2 * next_share / (0.5 + sqrt(0.25 + 2 * next_share)) END, 9) END AS next_position
FROM turns
"""
