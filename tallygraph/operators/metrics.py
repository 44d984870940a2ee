"""Scores of binary classifiers over rows (y, score), grouped by score before anything is ordered, so ties count as one threshold.

Cumulative counts run over distinct scores. They are numbered by ranges of the score, as counts by bucket first and within
buckets after, so that no order over all rows meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import probability
from ..graph import checkpointed, ranged


def grouped(scores: DataFrame) -> DataFrame:
    """score, p, n: positives and negatives at each score."""
    return scores.groupBy("score").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n"))


#: Distinct values that one task may order.
FEW = 200_000


def cumulated(counts: DataFrame, *columns: str, by: str = "score", within: tuple[str, ...] = ()) -> DataFrame:
    """counts, stored, with below_c: the sums of columns at lower values of by (in each group of within).

    A few distinct values are ordered by one task for each group; more by ranges of about equally many, however far apart.
    """
    stored = checkpointed(counts)
    before = lambda order, *keys: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    upto = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0.0))
    if stored.limit(FEW + 1).count() <= FEW:
        return stored.select("*", *[upto(c, before(by, *within)).alias(f"below_{c}") for c in columns])
    held = ranged(stored, *within, by)
    totals = held.groupBy(*within, "_bucket").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    starts = totals.select(*within, "_bucket", *[upto(f"_{c}", before("_bucket", *within)).alias(f"_s_{c}") for c in columns])
    ranked = held.select("*", *[upto(c, before(by, *within, "_bucket")).alias(f"_o_{c}") for c in columns]).join(starts, [*within, "_bucket"])
    return checkpointed(ranked.select(*counts.columns, *[(F.col(f"_s_{c}") + F.col(f"_o_{c}")).alias(f"below_{c}") for c in columns]))


def curve(scores: DataFrame) -> DataFrame:
    """score, p, n, below_p, below_n: every distinct score with its rows and those of lower ones; all metrics are sums over it."""
    return cumulated(grouped(scores), "p", "n")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of the values that are there, interpolated between neighbours in order; None without any."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return placed_quantiles(cumulated(counts, "n", by="value"), shares)


def placed_quantiles(placed: DataFrame, shares: list[float]) -> list[float | None]:
    """The same of distinct values with their rows n and those of lower ones, below_n. At most two rows for each share come to the driver."""
    total = int(placed.agg(F.coalesce(F.sum("n"), F.lit(0.0))).collect()[0][0])
    if not total:
        return [None] * len(shares)
    at = [q * (total - 1) for q in shares]
    ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    asked = F.broadcast(placed.sparkSession.createDataFrame([(float(r),) for r in ranks], "rank double"))
    rows = placed.join(asked, (F.col("rank") >= F.col("below_n")) & (F.col("rank") < F.col("below_n") + F.col("n"))).select("rank", "value").collect()
    value = {int(r["rank"]): r["value"] for r in rows}
    return [value[math.floor(x)] + (x - math.floor(x)) * (value[math.ceil(x)] - value[math.floor(x)]) for x in at]


def totals(c: DataFrame) -> DataFrame:
    """One row: positives and negatives of a curve."""
    return c.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("all_p"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("all_n"))


def area() -> Column:
    return F.try_divide(F.sum(F.col("p") * (F.col("below_n") + F.col("n") / 2)), F.sum("p") * F.sum("n"))


def precision() -> Column:
    """Of a curve with its totals beside each row."""
    tp, fp = F.col("all_p") - F.col("below_p"), F.col("all_n") - F.col("below_n")
    return F.sum(F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), F.col("p") / F.col("all_p") * tp / (tp + fp)))


def with_totals(c: DataFrame) -> DataFrame:
    return c.crossJoin(F.broadcast(totals(c)))  # one row


def roc_auc(scores: DataFrame) -> DataFrame:
    """One row, roc_auc: chance that a positive outranks a negative, ties half; NULL with one class."""
    return curve(scores).agg(F.round(area(), 6).alias("roc_auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """One row, pr_auc: sum over falling thresholds of the gain in recall times precision, without interpolation; NULL with one class."""
    return with_totals(curve(scores)).agg(F.round(precision(), 6).alias("pr_auc"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def f1_at(threshold: float) -> Column:
    """Of rows with score, p and n."""
    hit = F.col("score") >= threshold
    tp, fp = F.coalesce(F.sum(F.when(hit, F.col("p"))), F.lit(0.0)), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0.0))
    return f1_of(tp, fp, F.coalesce(F.sum(F.when(~hit, F.col("p"))), F.lit(0.0)))


def f1(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row, f1 at the threshold; 0 where it is undefined."""
    return grouped(scores).agg(F.round(f1_at(threshold), 6).alias("f1"))


def best_f1(scores: DataFrame, steps: int = 32) -> DataFrame:
    """One row, f1_best: the greatest F1 over the distinct interpolated quantiles 0, 1/steps, ..., 1 of the scores; 0 with one class."""
    c = curve(scores)
    placed = c.select(F.col("score").alias("value"), (F.col("p") + F.col("n")).alias("n"), (F.col("below_p") + F.col("below_n")).alias("below_n"))
    cut = sorted({q for q in placed_quantiles(placed, [k / steps for k in range(steps + 1)]) if q is not None})
    cuts = F.broadcast(c.sparkSession.createDataFrame([(t,) for t in cut], "t double"))  # at most steps + 1 rows
    each = with_totals(c).crossJoin(cuts).filter("score >= t").groupBy("t", "all_p", "all_n").agg(F.sum("p").alias("tp"), F.sum("n").alias("fp"))
    value = F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), f1_of(F.col("tp"), F.col("fp"), F.col("all_p") - F.col("tp"))).otherwise(0.0)
    return each.agg(F.round(F.coalesce(F.max(value), F.lit(0.0)), 6).alias("f1_best"))


def rate() -> Column:
    """Share of positives of a curve with its totals; NULL without rows."""
    return F.try_divide(F.max("all_p"), F.max("all_p") + F.max("all_n"))


def lift(scores: DataFrame) -> DataFrame:
    """One row: prevalence and pr_lift, average precision over max(prevalence, 1e-12)."""
    one = with_totals(curve(scores)).agg(rate().alias("rate"), precision().alias("ap"))
    return one.select(F.round("rate", 6).alias("prevalence"), F.round(F.col("ap") / F.greatest(F.col("rate"), F.lit(1e-12)), 4).alias("pr_lift"))


def positive_weight(labels: DataFrame, most: float = 50_000.0) -> DataFrame:
    """One row, pos_weight: negatives over positives, at most 50,000; 1 without positives."""
    p, n = F.sum("y").cast("double"), F.sum(1 - F.col("y")).cast("double")
    return labels.agg(F.round(F.when(p > 0, F.least(F.try_divide(n, p), F.lit(most))).otherwise(1.0), 6).alias("pos_weight"))


def bundle(logits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of all metrics of rows (y, logit): roc_auc, pr_auc, f1, f1_best, prevalence, pr_lift, n_pos, n_neg; all from one curve."""
    return bundles(logits.withColumn("_all", F.lit(0)), "_all", threshold).select(*METRICS).unionByName(nothing(logits))


METRICS = ("n_pos", "n_neg", "roc_auc", "pr_auc", "f1", "f1_best", "prevalence", "pr_lift")


def nothing(logits: DataFrame) -> DataFrame:
    """The metrics of no rows, if there are none: zero counts, else NULL but for F1, which is 0."""
    zero = {"n_pos": F.lit(0).cast("long"), "n_neg": F.lit(0).cast("long"), "f1": F.lit(0.0), "f1_best": F.lit(0.0)}
    one = logits.limit(1).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")
    return one.select(*[zero.get(c, F.lit(None).cast("double")).alias(c) for c in METRICS])


def bundles(logits: DataFrame, key: str, threshold: float = 0.5, steps: int = 32) -> DataFrame:
    """key and all metrics of rows (key, y, logit), a row for each key; one pass over the rows, and then only distinct scores.

    The thresholds of f1_best are interpolated quantiles. Each is found from the two scores that hold its neighbouring ranks,
    and the scores at least as high add up to its confusion counts.
    """
    grouped_ = logits.select(key, "y", probability(F.col("logit")).alias("score")).groupBy(key, "score").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n"))
    c = cumulated(grouped_, "p", "n", within=(key,))
    whole = c.groupBy(key).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    held = checkpointed(c.join(F.broadcast(whole), key))  # a row for each key
    rank = lambda k: k / F.lit(float(steps)) * (F.col("all_p") + F.col("all_n") - 1)
    low = F.col("below_p") + F.col("below_n")
    here = lambda r: (r >= low) & (r < low + F.col("p") + F.col("n"))
    near = lambda end: F.filter(F.sequence(F.lit(0), F.lit(steps)), lambda k: here(end(rank(k))))
    ends = [held.select(key, "score", F.explode(near(end)).alias("k"), F.lit(side).alias("side"), rank(F.col("k")).alias("at")) for side, end in enumerate((F.floor, F.ceil))]
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("score")))
    share = F.max("at") - F.floor(F.max("at"))
    cuts = ends[0].unionByName(ends[1]).groupBy(key, "k").agg((at(0) + share * (at(1) - at(0))).alias("t")).select(key, "t").distinct()
    each = held.join(F.broadcast(cuts), key).filter("score >= t").groupBy(key, "t", "all_p", "all_n").agg(F.sum("p").alias("tp"), F.sum("n").alias("fp"))  # steps + 1 for each key
    value = F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), f1_of(F.col("tp"), F.col("fp"), F.col("all_p") - F.col("tp"))).otherwise(0.0)
    best = each.groupBy(key).agg(F.round(F.coalesce(F.max(value), F.lit(0.0)), 6).alias("f1_best"))
    one = held.groupBy(key).agg(
        F.sum("p").cast("long").alias("n_pos"), F.sum("n").cast("long").alias("n_neg"), F.round(area(), 6).alias("roc_auc"), precision().alias("_ap"), F.round(f1_at(threshold), 6).alias("f1"), rate().alias("_rate"),
    )
    lifted = F.round(F.col("_ap") / F.greatest(F.col("_rate"), F.lit(1e-12)), 4)
    return one.join(F.broadcast(best), key).select(key, "n_pos", "n_neg", "roc_auc", F.round("_ap", 6).alias("pr_auc"), "f1", "f1_best", F.round("_rate", 6).alias("prevalence"), lifted.alias("pr_lift"))
