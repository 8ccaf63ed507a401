"""Incremental states over streams: nuisance variability, score histograms, hashed memories.

Each state is a table of mergeable sums that :func:`upsert` folds into a Parquet table batch by batch, or
a plain grouped aggregation in complete mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.operators.metrics import BINS, MAX_SCORE


def moments(pairs: DataFrame) -> DataFrame:
    """Mergeable sums of ``pairs(kind, v, w)`` for each kind and column: count, mean, centred square, change."""
    both = pairs.select("kind", F.posexplode(F.arrays_zip("v", "w")).alias("j", "p")).select("kind", "j", F.col("p.v").alias("x"), F.col("p.w").alias("z"))
    return both.groupBy("kind", "j").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("m2"), F.sum((F.col("z") - F.col("x")) * (F.col("z") - F.col("x"))).alias("change")
    )


def merge_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    """The moments of both parts together, by the pairwise update of means and centred squares."""
    whole = a.unionByName(b)
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    first = whole.groupBy("kind", "j").agg(n.alias("n"), mean.alias("mean"), F.sum("m2").alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("square"), F.sum("change").alias("change"))
    between = F.greatest(F.lit(0.0), F.col("square") - F.col("n") * F.col("mean") * F.col("mean"))
    return first.select("kind", "j", "n", "mean", (F.col("within") + between).alias("m2"), "change")


def ratios(state: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    return state.select("kind", "j", "n", (F.col("change") / F.col("n") / (F.col("m2") / F.col("n") + F.lit(epsilon))).alias("ratio"))


def stream_histogram(scores: DataFrame, bins: int = BINS, top: float = MAX_SCORE) -> DataFrame:
    """Running score histogram of a stream ``(y, s)``, for complete or update mode."""
    s = F.least(F.greatest(F.col("s"), F.lit(0.0)), F.lit(top - 1e-7))
    return scores.groupBy(F.floor(s * F.lit(bins / top)).cast("int").alias("bin")).agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))


class Accumulated:
    """A folded state on storage: every micro-batch writes the next version, then the pointer moves.

    Versions are numbered by batch, so a batch that is replayed after a failure overwrites its own version
    and counts once.
    """

    def __init__(self, spark: SparkSession, path: str, part, merge):
        self.spark, self.path, self.part, self.merge = spark, path.rstrip("/"), part, merge

    def _version(self, number: int) -> str:
        return f"{self.path}/batch={number}"

    def fold(self, batch: DataFrame, number: int) -> None:
        state = self.part(batch)
        before = self.read(number - 1)
        if before is not None:
            state = self.merge(before, state)
        state.write.mode("overwrite").parquet(self._version(number))

    def read(self, number: int) -> DataFrame | None:
        if number < 0:
            return None
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self._version(number) + "/_SUCCESS")
        exists = target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
        return self.spark.read.parquet(self._version(number)) if exists else None

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memory_state(rows: DataFrame, capacity: int, seed: int) -> DataFrame:
    """The rows with the least seeded hashes: a bounded uniform sample that merges."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")))
    return rows.withColumn("order", order).orderBy("order", "vec_id").limit(capacity)


def merge_memory(capacity: int):
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).dropDuplicates(["vec_id"]).orderBy("order", "vec_id").limit(capacity)

    return merge
