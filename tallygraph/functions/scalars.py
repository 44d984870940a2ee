"""Scalar transforms of raw transaction columns. Missing is NULL throughout, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMESTAMP = "yyyy/MM/dd HH:mm"


def normal_names(df: DataFrame) -> DataFrame:
    """Column names stripped and lower-cased."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def entity_type(name: Column) -> Column:
    """A name without its trailing number: 'Partnership #12' gives 'Partnership'; a missing name is the category 'nan'."""
    return F.coalesce(F.trim(F.regexp_replace(name, r"\s+#\d+$", "")), F.lit("nan"))


def parsed_time(text: Column, pattern: str = TIMESTAMP) -> Column:
    """A timestamp, NULL where the text is none."""
    return F.try_to_timestamp(text, F.lit(pattern))


def seconds_since(ts: Column, start: Column) -> Column:
    """Seconds since the first timestamp; a missing one counts as the first."""
    return F.coalesce((F.unix_timestamp(ts) - F.unix_timestamp(start)).cast("double"), F.lit(0.0))


def log_amount(amount: Column) -> Column:
    """log(1 + amount), negative amounts as 0, missing ones missing."""
    return F.when(amount.isNotNull(), F.log1p(F.greatest(F.lit(0.0), amount.cast("double"))))


def finite(x: Column) -> Column:
    """NULL in place of NaN and infinities."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def probability(logit: Column) -> Column:
    """Logistic function of the logit clipped to 40 either way."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit))))


def resized(vector: Column, size: int) -> Column:
    """A vector padded with zeros or cut to the size."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size) if size else F.array().cast("array<float>")


def one_hot_class(vector: Column) -> Column:
    """Position, from 0, of the first greatest component."""
    return F.array_position(vector, F.array_max(vector)).cast("int") - 1


def one_hot(value: Column, categories: list[str]) -> list[Column]:
    """One 0/1 column for each category in order; a value outside them is all zeros."""
    return [F.coalesce((value == F.lit(c)).cast("double"), F.lit(0.0)) for c in categories]


def bernoulli(u: Column, rate: float) -> Column:
    """1 with the rate clipped to [0, 0.5]."""
    return (u < F.lit(min(0.5, max(0.0, rate)))).cast("int")
