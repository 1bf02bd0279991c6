"""Agent run logs (JSON lines): totals per run, medians per arm, savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolweave.functions import display
from symbolweave.lineage import cut

RUN_LOG = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField(
            "part",
            T.StructType(
                [
                    T.StructField("cost", T.DoubleType()),
                    T.StructField(
                        "tokens",
                        T.StructType(
                            [
                                T.StructField("total", T.LongType()),
                                T.StructField("cache", T.StructType([T.StructField("read", T.LongType())])),
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)
METRICS = ["cost", "tokens", "tool_calls", "time_seconds", "cache_reads"]


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log events with their file as ``run`` and their place in it as ``seq``.

    Within a file, split order and order inside a split give the line order.
    """
    lines = spark.read.schema(RUN_LOG).json(path)
    return lines.select(
        "*",
        F.col("_metadata.file_path").alias("run"),
        F.struct(
            F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("seq"),
    )


def run_totals(events: DataFrame, run: str = "run", seq: str = "seq") -> DataFrame:
    """One row per run.  Time is from the first to the last stamped event in log order."""
    finished = F.col("type") == "step_finish"

    def total(value: Column, kind: str) -> Column:
        return F.coalesce(F.sum(F.when(finished, value)), F.lit(0).cast(kind))

    stamp = F.col("timestamp")
    place = F.when(stamp.isNotNull(), F.col(seq))
    elapsed = F.max_by(stamp, place) - F.min_by(stamp, place)
    return events.groupBy(run).agg(
        total(F.col("part.cost"), "double").alias("cost"),
        total(F.col("part.tokens.total"), "bigint").alias("tokens"),
        F.count_if(F.col("type") == "tool_use").alias("tool_calls"),
        F.coalesce(elapsed, F.lit(0.0)).alias("time_seconds"),
        total(F.col("part.tokens.cache.read"), "bigint").alias("cache_reads"),
    )


def exact_medians(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Median per group; of an even number, the mean of the middle two cut to cents.

    Equal values are counted first.  The distinct values are then sorted across
    the cluster, every range numbered on its own and shifted by the ranges before
    it, so no task ever holds a whole group.
    """
    counts = rows.groupBy(*groups, value).agg(F.count("*").alias("n"))
    placed = cut(
        counts.repartitionByRange(*groups, value).withColumn("stretch", F.spark_partition_id()),
        "sorted",
    ).df
    stretches = placed.groupBy(*groups, "stretch").agg(F.sum("n").alias("held"))
    order = Window.partitionBy(*groups).orderBy("stretch")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select(
        *groups,
        "stretch",
        F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"),
        F.sum("held").over(Window.partitionBy(*groups)).alias("total"),
    )
    inside = Window.partitionBy(*groups, "stretch").orderBy(value)
    ranked = placed.join(offsets, [*groups, "stretch"]).withColumn(
        "last", F.col("before") + F.sum("n").over(inside)
    )
    first = F.col("last") - F.col("n") + 1
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = ranked.filter((F.col("last") >= low) & (first <= high))
    mean = (F.min(value) + F.max(value)) / 2
    return middle.groupBy(*groups).agg(
        F.when(F.max("total") % 2 == 1, F.min(value).cast("double"))
        .otherwise(display.truncated(mean, 2))
        .alias("median")
    )


def arm_medians(runs: DataFrame, arm: str = "arm") -> DataFrame:
    """Medians of every metric per arm, in long form."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in METRICS)
    long = runs.select(arm, F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, value)"))
    return exact_medians(long, [arm, "metric"], "value")


def savings_report(medians: DataFrame, arm: str = "arm") -> DataFrame:
    """One row per metric: both arms as shown, and what the tool saved."""

    def of(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col(arm) == name, F.col("median"))), F.lit(0.0))

    wide = medians.groupBy("metric").agg(of("with").alias("w"), of("without").alias("wo"))

    def shown(value: Column) -> Column:
        return (
            F.when(F.col("metric") == "cost", display.cost(value))
            .when(F.col("metric") == "time_seconds", display.duration(value))
            .when(F.col("metric") == "tool_calls", F.format_string("%.0f", F.bround(value, 0)))
            .otherwise(display.amount(value))
        )

    return wide.select(
        "metric",
        shown(F.col("w")).alias("with_tool"),
        shown(F.col("wo")).alias("without_tool"),
        display.savings(F.col("w"), F.col("wo")).alias("savings"),
    )
