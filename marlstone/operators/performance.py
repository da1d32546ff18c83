"""Timing analytics over raw measurements (ts, language, file_size, duration_ms, operation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import columns as C


def _r(c: Column) -> Column:
    return F.round(c, 6)


#: Accuracy of the sketch that brackets a quantile: the bracket holds about six of so many parts of the rows. The bracket of a group of
#: so many rows or fewer is the group.
ACCURACY = 10_000


def quantile_by(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank quantiles by group, or of all rows without ``by``; nulls don't count.

    A sketch that combines before the shuffle brackets each quantile. A second pass counts the rows below a bracket and the values
    within it, and the quantile of rank r is the least value whose running count exceeds r. So no task sorts a group,
    only the distinct values of one bracket, about n / 1,700 of n rows.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ends = [min(1.0, max(0.0, q + d / ACCURACY)) for q in quantiles.values() for d in (-3, 3)]
    marks = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", ends, ACCURACY).alias("_p"))
    few = F.col("_n") <= ACCURACY
    brackets = marks.select(*by, F.array(*[
        F.struct(F.lit(name).alias("name"), F.floor((F.col("_n") - 1) * F.lit(q) + 0.5).alias("rank"), F.when(few, F.col("_least")).otherwise(F.col("_p")[2 * i]).alias("lo"),
                 F.when(few, F.col("_most")).otherwise(F.col("_p")[2 * i + 1]).alias("hi"))
        for i, (name, q) in enumerate(quantiles.items())]).alias("_b"))
    # without groups there is one row of brackets
    both = rows.join(brackets, by) if by else rows.crossJoin(F.broadcast(brackets))
    each = both.select(*by, "_v", F.explode("_b").alias("b")).filter("_v <= b.hi")
    inside = F.col("_v") >= F.col("b.lo")
    counts = (each.groupBy(*by, "b.name", "b.rank", F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c")))
    w = Window.partitionBy(*by, "name").orderBy(F.col("_v").asc_nulls_first())
    run = counts.withColumn("_upto", F.sum("_c").over(w)).filter(F.col("_v").isNotNull() & (F.col("_upto") > F.col("rank")))
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in quantiles])


def stats_by(rows: DataFrame, by: list[str], quantiles: dict[str, float], value: str = "duration_ms") -> DataFrame:
    v = F.col(value)
    base = rows.groupBy(*by).agg(F.count(v).alias("n"), _r(F.avg(v)).alias("mean_ms"), _r(F.stddev_samp(v)).alias("std_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"))
    return base.join(quantile_by(rows, by, value, quantiles), by) if quantiles else base


def language_stats(rows: DataFrame, operation: str, p99: bool = True) -> DataFrame:
    q = {"p50": 0.5, "p95": 0.95} | ({"p99": 0.99} if p99 else {})
    return stats_by(rows.filter(F.col("operation") == operation), ["language"], q)


def slowest(stats: DataFrame, k: int = 5) -> DataFrame:
    return stats.orderBy(F.desc("mean_ms"), "language").limit(k)


def bucket_stats(rows: DataFrame, operation: str) -> DataFrame:
    out = stats_by(rows.filter(F.col("operation") == operation).withColumn("bucket", C.size_bucket("file_size")), ["bucket"], {"p50": 0.5, "p95": 0.95})
    return out.withColumn("bucket_order", C.bucket_order("bucket"))


def online_stats(rows: DataFrame) -> DataFrame:
    """Count, total, mean, least and greatest time by key and size bucket; parser and tokenizer have keys of their own."""
    key = F.when(F.col("operation").isin("parser", "tokenizer"), F.concat_ws("_", "language", "operation")).otherwise(F.col("language"))
    d = F.col("duration_ms")
    return (rows.withColumn("key", key).withColumn("bucket", C.size_bucket("file_size")).groupBy("key", "bucket")
            .agg(F.count("*").alias("n"), _r(F.sum(d)).alias("total_ms"), _r(F.sum(d) / F.count("*")).alias("avg_ms"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms")))


def throughput_by_bucket(rows: DataFrame, operation: str) -> DataFrame:
    rate = F.when(F.col("duration_ms") > 0, F.col("file_size") / F.col("duration_ms"))
    return (rows.filter(F.col("operation") == operation).withColumn("bucket", C.size_bucket("file_size")).groupBy("bucket")
            .agg(_r(F.avg(rate)).alias("mean_bytes_per_ms")).withColumn("bucket_order", C.bucket_order("bucket")))


def log_by_language(rows: DataFrame) -> DataFrame:
    return rows.groupBy("language").agg(F.count("*").alias("files"), _r(F.avg("duration_ms")).alias("mean_ms"), F.sum("file_size").alias("total_bytes"), _r(F.avg("file_size")).alias("mean_bytes"))


def outliers(rows: DataFrame, operation: str, q: float = 0.95) -> DataFrame:
    """How many measurements of each language and bucket lie above the q-quantile of all."""
    part = rows.filter(F.col("operation") == operation)
    cut = quantile_by(part, [], "duration_ms", {"cut": q})
    return (part.crossJoin(F.broadcast(cut)).filter("duration_ms > cut").withColumn("bucket", C.size_bucket("file_size"))
            .groupBy("language", "bucket").agg(F.count("*").alias("outliers")))


def operation_ratio(rows: DataFrame, over: str = "parser", under: str = "tokenizer") -> DataFrame:
    """Ratio of the mean times of two operations at equal language and size: its mean, deviation and greatest value."""
    mean = lambda op, name: rows.filter(F.col("operation") == op).groupBy("language", "file_size").agg(F.avg("duration_ms").alias(name))
    both = mean(over, "a").join(mean(under, "b"), ["language", "file_size"]).filter("b > 0").withColumn("ratio", F.col("a") / F.col("b"))
    return both.groupBy("language").agg(_r(F.avg("ratio")).alias("mean_ratio"), _r(F.stddev_samp("ratio")).alias("std_ratio"), _r(F.max("ratio")).alias("max_ratio"), F.sum((F.col("ratio") > 10).cast("long")).alias("above_10"))


def slow_tail(rows: DataFrame, operation: str, q: float = 0.1, k: int = 10) -> DataFrame:
    """The k slowest files by throughput below its q-quantile."""
    part = rows.filter((F.col("operation") == operation) & (F.col("duration_ms") > 0)).withColumn("rate", _r(F.col("file_size") / F.col("duration_ms")))
    cut = quantile_by(part, [], "rate", {"cut": q})
    return part.crossJoin(F.broadcast(cut)).filter("rate < cut").orderBy("rate", "row_id").limit(k).select("row_id", "language", "file_size", "duration_ms", "rate")


def mean_pivot(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Mean time, languages down and ``values`` across."""
    p = rows.groupBy("language").pivot(column, values).agg(_r(F.avg("duration_ms")))
    return p.select("language", *[F.col(f"`{v}`").alias(v.lower().replace("-", "_").replace("+", "_up")) for v in values])


def running_files(rows: DataFrame) -> DataFrame:
    """Files seen so far by language, in order of time.

    A language is counted by days first, so that the window over a language holds its days; within
    a day rows are ranked among themselves.
    """
    day = F.to_date("ts")
    rows = rows.withColumn("day", day)
    days = rows.groupBy("language", "day").agg(F.count("*").alias("c"))
    before = days.withColumn("before", F.sum("c").over(Window.partitionBy("language").orderBy("day")) - F.col("c")).drop("c")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("language", "day").orderBy("ts", "row_id")))
    return ranked.join(before, ["language", "day"]).select("row_id", "language", "ts", (F.col("before") + F.col("r")).alias("files_so_far"))
