"""Measuring detectors: confusion, calibration, agreement, controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the 97.5th percentile of the normal distribution.
Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of a share; null without observations."""
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = successes / n
    middle = (p + Z95 * Z95 / (2 * n)) / (1 + Z95 * Z95 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + Z95 * Z95 / (4 * n * n)) / (1 + Z95 * Z95 / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def with_scores(counts: DataFrame, digits: int = 4) -> DataFrame:
    """precision, recall and f1 from the columns tp, fp and fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(ratio(2 * p * r, p + r), digits)})


def rule_confusion(samples: DataFrame, expected: str, fired: str) -> DataFrame:
    """rule, tp, fp, fn, tn over samples with one expected rule and an array of fired rules.

    Rules that never fired count too: their negatives come from the number of samples, not from a product of rules
    and samples.
    """
    total = samples.agg(F.count(F.lit(1)).alias("n"))
    wanted = samples.where(F.col(expected) != "").groupBy(F.col(expected).alias("rule")).agg(F.count(F.lit(1)).alias("positives"), F.count_if(F.array_contains(fired, F.col(expected))).alias("tp"))
    wrong = samples.select(F.col(expected).alias("_e"), F.explode(F.array_distinct(fired)).alias("rule")).where(F.col("_e").isNull() | (F.col("rule") != F.col("_e"))).groupBy("rule").agg(F.count(F.lit(1)).alias("fp"))
    both = wanted.join(wrong.withColumnRenamed("rule", "_r"), F.col("rule") == F.col("_r"), "full_outer").join(F.broadcast(total))
    zero = F.lit(0).cast("long")
    both = both.select(F.coalesce("rule", "_r").alias("rule"), F.coalesce("tp", zero).alias("tp"), F.coalesce("fp", zero).alias("fp"), F.coalesce(F.col("positives") - F.col("tp"), zero).alias("fn"), "n")
    return both.withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).drop("n")


def calibration(observations: DataFrame, score: str, outcome: str, strata: list[list[str]], *, bins: int = 10, least: int = 30) -> DataFrame:
    """Calibration bins for each set of columns in `strata`: samples, correct, mean score, share, interval.

    One expansion and one aggregation serve all strata. `share` is null in bins with fewer than `least` samples.
    """
    keys = sorted({c for s in strata for c in s})
    rows = observations.where(F.col(score).between(0, 1)).withColumn("bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int"))
    levels = F.explode(F.array(*[F.struct(*[(F.col(c) if c in s else F.lit(None).cast("string")).alias(c) for c in keys], F.lit(",".join(s)).alias("stratum")) for s in strata]))
    grouped = rows.select(levels.alias("g"), "bin", score, outcome).groupBy("g.stratum", *[f"g.{c}" for c in keys], "bin")
    out = grouped.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col(outcome)).alias("correct"), F.avg(score).alias("mean"), F.avg(F.pow(F.col(score) - F.col(outcome).cast("double"), 2)).alias("brier"))
    low, high = wilson(F.col("correct"), F.col("samples"))
    return out.withColumns({"share": F.when(F.col("samples") >= least, F.col("correct") / F.col("samples")), "low": low, "high": high})


def hash_share(column: Column, parts: int = 5) -> Column:
    """The remainder of the SHA-256 of a text, read as one number, by 5 or 3: the sum of its hexadecimal digits has the same."""
    if parts not in (3, 5, 15):
        raise ValueError("only for divisors of 15")
    digits = F.split(F.sha2(column, 256), "")
    return F.pmod(F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: a + F.conv(d, 16, 10).cast("int")), F.lit(parts))


def set_digest(ids: DataFrame, column: str) -> DataFrame:
    """One row that tells a set of ids apart whatever its order: number, and exclusive-or of 60 bits of each SHA-256.

    Partial results combine before the exchange; no list of ids is ever gathered.
    """
    bits = F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 15), 16, 10).cast("long")
    return ids.where(F.col(column).isNotNull()).select(F.col(column)).distinct().agg(F.count(F.lit(1)).alias("ids"), F.bit_xor(bits).alias("digest"))
