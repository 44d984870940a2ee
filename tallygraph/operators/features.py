"""Node universe, labels and features, all fitted on the whole slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import log_amount, one_hot, seconds_since
from ..graph import endpoints, numbered
from .metrics import quantiles

UNKNOWN = "Unknown"
#: Values that a one-hot encoded column may have.
CATEGORIES = 1000


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def node_universe(accounts: DataFrame, edges: DataFrame) -> DataFrame:
    """account_id and node_idx, dense by first appearance: listed accounts by (side, number), then all sources, then all destinations by eid."""
    at = lambda rank, ordinal: F.struct(rank.cast("int").alias("part"), ordinal.cast("long").alias("at"))
    seen = (
        accounts.select("account_id", at(F.col("side"), F.col("number")).alias("x"))
        .unionAll(edges.select(F.col("src"), at(F.lit(2), F.col("eid"))))
        .unionAll(edges.select(F.col("dst"), at(F.lit(3), F.col("eid"))))
    )
    least = seen.groupBy("account_id").agg(F.min("x").alias("x"))
    return numbered(least, None, "x", "account_id", name="node_idx", keep=("account_id",)).select("account_id", "node_idx")


def risky_nodes(edges: DataFrame) -> DataFrame:
    """Distinct ends of positive edges."""
    return endpoints(edges.filter("y = 1"))


def labelled(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """nodes with y = 1 where an end of a positive edge."""
    risky = risky_nodes(edges).select(F.col("node").alias("_risky"))
    return nodes.join(risky, nodes[node] == risky["_risky"], "left").withColumn("y", F.col("_risky").isNotNull().cast("int")).drop("_risky")


def median_filled(df: DataFrame, column: str) -> DataFrame:
    """Missing values become the exact median of the observed ones (0 without any)."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(quantiles(df, column, [0.5])[0]).cast("double"), F.lit(0.0)))


def scaled(df: DataFrame, columns: dict[str, Column | str], suffix: str = "_scaled") -> DataFrame:
    """Columns less their mean over their population deviation (1 where that is 0); missing values are left out of the fit and stay."""
    held = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_{name}") for name, c in columns.items()])
    fit = held.agg(*[x for n in columns for x in (F.avg(f"_{n}").alias(f"_m_{n}"), F.stddev_pop(f"_{n}").alias(f"_s_{n}"))])
    joined = held.crossJoin(F.broadcast(fit))  # one row
    spread = lambda n: F.when(F.col(f"_s_{n}") == 0, 1.0).otherwise(F.col(f"_s_{n}"))
    return joined.select(*df.columns, *[((F.col(f"_{n}") - F.col(f"_m_{n}")) / spread(n)).alias(n + suffix) for n in columns])


def categories(df: DataFrame, column: str) -> list[str]:
    """The distinct values in order; each becomes a column, so over CATEGORIES are an error."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(CATEGORIES + 1).collect()]
    if len(found) > CATEGORIES:
        raise ValueError(f"{column} has over {CATEGORIES} values")
    return sorted(found)


def interleaved_universe(edges: DataFrame) -> DataFrame:
    """account_id and node_idx, dense by first appearance when rows are read one by one, source before destination."""
    at = lambda side: F.struct(F.col("eid").alias("eid"), F.lit(side).alias("side")).alias("x")
    seen = edges.select(F.col("src").alias("account_id"), at(0)).unionAll(edges.select("dst", at(1)))
    return numbered(seen.groupBy("account_id").agg(F.min("x").alias("x")), None, "x", name="node_idx").select("account_id", "node_idx")


def edge_features(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """edges with scaled log amount, seconds and banks, one 0/1 column for each payment format, and the columns' names."""
    start = edges.agg(F.min("ts").alias("_t0"))
    timed = edges.crossJoin(F.broadcast(start))
    columns = {"amt": log_amount(F.col("amt")), "dt": seconds_since(F.col("ts"), F.col("_t0"))} | {b: F.col(b) for b in ("from_bank", "to_bank") if b in edges.columns}
    out, formats = scaled(timed, columns).drop("_t0"), categories(edges, "fmt")
    names = [f"fmt_{k}" for k in range(len(formats))]
    return out.select("*", *[c.alias(n) for c, n in zip(one_hot(F.col("fmt"), formats), names, strict=True)]), [f"{c}_scaled" for c in columns] + names


def node_features(nodes: DataFrame, degrees: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """nodes with a scaled bank, one 0/1 column for each entity type and, if given, scaled degrees, and the columns' names."""
    filled = median_filled(nodes.withColumn("entity_type", F.coalesce("entity_type", F.lit(UNKNOWN))), "bank")
    columns: dict[str, Column | str] = {"bank": "bank"}
    if degrees is not None:
        filled, columns = filled.join(degrees, "node", "left").fillna(0, ["in_deg", "out_deg"]), columns | {"in_deg": "in_deg", "out_deg": "out_deg"}
    kinds = categories(filled, "entity_type")
    names = [f"type_{k}" for k in range(len(kinds))]
    out = scaled(filled, columns)
    return out.select("*", *[c.alias(n) for c, n in zip(one_hot(F.col("entity_type"), kinds), names, strict=True)]), [f"{c}_scaled" for c in columns] + names


def median_bits(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as 0/1 by strictly exceeding their median; those that come out constant are dropped."""
    medians = {c: quantiles(df, c, [0.5])[0] for c in columns}
    bits = df.select(*[c for c in df.columns if c not in columns], *[(F.col(c) > F.lit(medians[c]).cast("double")).cast("int").alias(c) for c in columns])
    total = bits.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns]).collect()[0]
    return bits.drop(*[c for c in columns if total[c] in (0, total["n"], None)])
