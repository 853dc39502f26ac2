"""Analytic functions over ordered rows.

Every window is partitioned by what the caller names; `keys=[]` is for tables already reduced to a bounded
number of rows (days, weeks), where one partition is what an ordered series needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], order: list[Column | str]) -> Window:
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return spec.orderBy(*order)


def percent_change(df: DataFrame, value: str, order: str, *, keys: list[str] = [], digits: int = 1, name: str = "change_pct") -> DataFrame:
    """Change against the row before in percent; null on the first row and after values that are not positive."""
    before = F.lag(value).over(_over(keys, [order]))
    return df.withColumn(name, F.when(before > 0, F.round((F.col(value) - before) / before * 100, digits)))


def trailing_zscore(df: DataFrame, value: str, order: str, *, rows: int = 7, keys: list[str] = []) -> DataFrame:
    """z of each value against the `rows` rows before it: mean, sample deviation; null before there are so many or at deviation 0."""
    frame = _over(keys, [order]).rowsBetween(-rows, -1)
    full = df.withColumns({"_n": F.count(value).over(frame), "mean": F.avg(value).over(frame), "deviation": F.stddev_samp(value).over(frame)})
    ready = (F.col("_n") == rows) & (F.col("deviation") > 0)
    return full.withColumn("z", F.when(ready, (F.col(value) - F.col("mean")) / F.col("deviation"))).drop("_n")


def global_zscore(df: DataFrame, value: str, *, least: int = 7) -> DataFrame:
    """z of each value against all; null with fewer than `least` rows or at deviation 0. One aggregate, joined back as one row."""
    stats = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count(value).alias("_n"))
    ready = (F.col("_n") >= least) & (F.col("deviation") > 0)
    return df.join(F.broadcast(stats)).withColumn("z", F.when(ready, (F.col(value) - F.col("mean")) / F.col("deviation"))).drop("_n")


def prefer_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union of both, rows of `second` only for keys that `first` lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def linear_forecast(series: DataFrame, order: str, value: str, *, horizon: int = 7, least: int = 14) -> DataFrame:
    """Least-squares line through a daily series and its next days: day, forecast, low, high.

    The interval is 1.96 s sqrt(1 + 1/n + (x - mean)^2 / Sxx) with the sample deviation s of the residuals; values stay at
    0 or above. Fewer than `least` days give no rows.
    """
    indexed = series.withColumn("x", (F.row_number().over(_over([], [order])) - 1).cast("double"))
    fit = indexed.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(order).alias("last"),
        F.regr_slope(value, "x").alias("slope"),
        F.regr_intercept(value, "x").alias("intercept"),
        F.avg("x").alias("mean_x"),
        F.regr_sxx(value, "x").alias("sxx"),
    ).where(F.col("n") >= least)
    residuals = indexed.join(F.broadcast(fit)).agg(F.stddev_samp(F.col(value) - F.col("intercept") - F.col("slope") * F.col("x")).alias("s"))
    ahead = fit.join(F.broadcast(residuals)).select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    at = F.col("n") - 1 + F.col("step")
    middle = F.col("intercept") + F.col("slope") * at
    width = 1.96 * F.col("s") * F.sqrt(1 + 1 / F.col("n") + (at - F.col("mean_x")) * (at - F.col("mean_x")) / F.greatest(F.col("sxx"), F.lit(1.0)))
    return ahead.select(
        F.date_add("last", F.col("step").cast("int")).alias("day"),
        *(F.round(F.greatest(x, F.lit(0.0)), 2).alias(name) for x, name in ((middle, "forecast"), (middle - width, "low"), (middle + width, "high"))),
    )


def occurrence(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "occurrence") -> DataFrame:
    """The number of each row among those of its key."""
    return df.withColumn(name, F.row_number().over(_over(keys, order)))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return occurrence(df, keys, order, "_nth").where("_nth = 1").drop("_nth")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """At most `n` rows of each key."""
    return occurrence(df, keys, order, "_nth").where(F.col("_nth") <= n).drop("_nth")


def carry_forward(df: DataFrame, value: str, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The last non-null value so far, inside each key."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def gap_profile(events: DataFrame, keys: list[str], at: str, *, least: int = 6) -> DataFrame:
    """Gaps between consecutive events of a key in seconds: events, mean_gap, jitter (mean distance from it over it).

    Keys with fewer than `least` events or a mean gap of 0 are left out.
    """
    seconds = events.select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    gaps = seconds.withColumn("gap", (F.col("_us") - F.lag("_us").over(_over(keys, ["_us"]))) / 1e6)
    mean = F.avg("gap").over(Window.partitionBy(*keys))
    spread = gaps.withColumn("_mean", mean)
    out = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.avg("gap").alias("mean_gap"), F.avg(F.abs(F.col("gap") - F.col("_mean"))).alias("_dev"))
    return out.where((F.col("events") >= least) & (F.col("mean_gap") > 0)).withColumn("jitter", F.col("_dev") / F.col("mean_gap")).drop("_dev")


def batches(df: DataFrame, order: str, size: int, *, keys: list[str] = []) -> DataFrame:
    """`batch`: consecutive rows of a key in groups of `size`."""
    return df.withColumn("batch", F.floor((F.row_number().over(_over(keys, [order])) - 1) / size))


def islands(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Maximal runs of consecutive positions of a key: first, last, length. Repeated positions count once."""
    spots = df.select(*keys, F.col(position).alias("_p")).distinct()
    runs = spots.withColumn("_g", F.col("_p") - F.row_number().over(_over(keys, ["_p"])))
    return runs.groupBy(*keys, "_g").agg(F.min("_p").alias("first"), F.max("_p").alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")
