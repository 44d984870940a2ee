"""How far two graphs, or two samples of features, are apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import cumulated


def histogram_l1(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """One row, l1, of two histograms (deg, n) up to the real one's greatest degree; NULL where the synthetic one ends earlier."""
    tops = real.agg(F.max("deg").alias("r")).crossJoin(F.broadcast(synthetic.agg(F.max("deg").alias("s"))))
    both = real.select("deg", F.col("n").alias("a")).join(synthetic.select("deg", F.col("n").alias("b")), "deg", "full_outer").crossJoin(F.broadcast(tops))
    gap = F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))
    return both.agg(F.sum(F.when((F.col("s") >= F.col("r")) & (F.col("deg") <= F.col("r")), gap)).cast("double").alias("l1"))


def long_form(df: DataFrame, sample: Column, columns: list[str]) -> DataFrame:
    """dim, value, sample: a row for each feature of each row."""
    return df.select(sample.alias("sample"), F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.dim", "x.value", "sample")


def ks(values: DataFrame) -> DataFrame:
    """dim, ks, the greatest gap of the two samples' distribution functions, and p, its p-value; sample is 0 or 1, missing values are left out."""
    held = values.filter(F.col("value").isNotNull())
    counts = held.groupBy("dim", "value").agg(F.sum(1 - F.col("sample")).cast("double").alias("c0"), F.sum("sample").cast("double").alias("c1"))
    total = counts.groupBy("dim").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    upto = cumulated(counts, "c0", "c1", by="value", within=("dim",)).join(F.broadcast(total), "dim")  # a row for each feature
    gap = F.abs(F.try_divide(F.col("below_c0") + F.col("c0"), F.col("n0")) - F.try_divide(F.col("below_c1") + F.col("c1"), F.col("n1")))
    found = upto.groupBy("dim").agg(F.max(gap).alias("gap"), F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    return found.select("dim", F.round("gap", 6).alias("ks"), F.round(ks_p_value(F.col("gap"), F.col("n0"), F.col("n1")), 9).alias("p"))


def ks_summary(gaps: DataFrame) -> DataFrame:
    """One row, ks_mean, ks_max and p_mean of all features."""
    return gaps.agg(F.round(F.avg("ks"), 6).alias("ks_mean"), F.max("ks").alias("ks_max"), F.round(F.avg("p"), 9).alias("p_mean"))


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Two-sided p-value of the gap d of samples of n and m, from the limit distribution with the first-order shift; NULL without rows in either."""
    n, m = n.cast("double"), m.cast("double")
    root = F.sqrt(F.try_divide(n * m, n + m))
    x = root * d + F.try_divide(F.lit(1.0), 6 * root)
    term = lambda total, k: total + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), term)
    return F.when(x < 0.2, 1.0).when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def correlation(a: str, b: str) -> Column:
    """Pearson's coefficient as an aggregate; 0 where a column is constant, which its range tells: merged over tasks, its deviation may miss 0 by rounding."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    flat = lambda c: F.max(c) - F.min(c) == 0
    return F.when(flat(x) | flat(y), 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)))


def correlation_distance(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """One row, corr_fro: the Frobenius norm of the difference of the correlation matrices."""
    both = real.select(F.lit(0).alias("sample"), *columns).unionByName(synthetic.select(F.lit(1).alias("sample"), *columns))
    return tagged_correlation_distance(both, F.col("sample"), columns).select(F.round("corr_fro", 6).alias("corr_fro"))


def tagged_correlation_distance(rows: DataFrame, sample: Column, columns: list[str]) -> DataFrame:
    """One row, corr_fro, of the rows of sample 0 and 1, from one pass over both; in a sample without rows nothing correlates."""
    pairs = [(a, b) for a in columns for b in columns]
    each = rows.groupBy(sample.alias("sample")).agg(F.array(*[correlation(a, b) for a, b in pairs]).alias("r"))
    none = F.array(*[F.lit(0.0)] * len(pairs))
    both = each.agg(*[F.coalesce(F.max(F.when(F.col("sample") == k, F.col("r"))), none).alias(f"r{k}") for k in (0, 1)])
    gap = F.aggregate(F.zip_with("r0", "r1", lambda x, y: F.pow(x - y, 2)), F.lit(0.0), lambda total, x: total + x)
    return both.select(F.sqrt(gap).alias("corr_fro"))
