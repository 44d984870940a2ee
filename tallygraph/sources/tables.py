"""Two transaction graphs derived from relational tables, as DataFrames and as SQL.

The trade graph has customers and suppliers as accounts and line items as payments from one to the other; the hop graph
links the users of successive events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import numbered

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")

EDGE = ("src", "dst", "ts", "amt", "fmt", "y")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, bank, entity_type, and ordinal in which accounts are listed: (0 customer or 1 supplier, key)."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("account_id"), F.col("c_nationkey").cast("double").alias("bank"), F.col("c_mktsegment").alias("entity_type"), F.lit(0).alias("side"), F.col("c_custkey").alias("number"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("account_id"), F.col("s_nationkey").cast("double").alias("bank"), F.lit("SUPPLIER").alias("entity_type"), F.lit(1).alias("side"), F.col("s_suppkey").alias("number"))
    return c.unionByName(s)


def _trade_lines(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    """Line items with their label y and their orders' columns, of which SHOWN makes the trade graph's."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    discount, quantity = (0.095, 50) if strict else (0.09, 45)
    y = ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= discount) & (F.col("l_quantity") >= quantity)).cast("int")
    return table(spark, sf_dir, "lineitem").select(*ORDER, y.alias("y")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))


#: Of each of EDGE's columns: the column it is made of, and the text before its number.
SHOWN = {"src": ("o_custkey", "C"), "dst": ("l_suppkey", "S"), "ts": ("l_shipdate", ""), "amt": ("l_extendedprice", ""), "fmt": ("o_orderpriority", ""), "y": ("y", "")}


def _shown(column: str) -> Column:
    held, prefix = SHOWN[column]
    return (F.concat(F.lit(prefix), held) if prefix else F.col(held)).alias(column)


def trade_rows(spark: SparkSession, sf_dir: str, *, strict: bool = False) -> DataFrame:
    """src, dst, ts, amt, fmt, y of the trade graph and what orders them; strict labels are rarer."""
    return _trade_lines(spark, sf_dir, strict).select(*[_shown(c) for c in EDGE], *ORDER)


def trade_edges(spark: SparkSession, sf_dir: str, *, strict: bool = False, columns: Sequence[str] = EDGE) -> DataFrame:
    """eid and the columns: numbered over ranges of about equal size, however the keys are spread. Columns are sorted and stored as the tables have them, and only those asked for."""
    held = numbered(_trade_lines(spark, sf_dir, strict), None, *ORDER, name="eid", keep=[SHOWN[c][0] for c in columns])
    return held.select("eid", *[_shown(c) for c in columns])


def hop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, src, dst, ts, amt, fmt, y: from each event's user to the next event's. Events are numbered over ranges of about equal size, as an hour may hold them all."""
    e = numbered(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), None, "ts", "event_id", name="nth")
    after = e.select((F.col("nth") - 1).alias("nth"), F.col("user_id").alias("dst"))
    y = ((F.col("event_type") == "error") & (F.col("value") > 100)).cast("int")
    return e.join(after, "nth").select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), "dst", "ts", F.col("value").alias("amt"), F.col("event_type").alias("fmt"), y.alias("y"))


TRADE_ACCOUNTS_SQL = """ta AS (
  SELECT 'C' || c_custkey AS account_id, CAST(c_nationkey AS DOUBLE) AS bank, c_mktsegment AS entity_type, 0 AS side, c_custkey AS number FROM customer
  UNION ALL SELECT 'S' || s_suppkey, CAST(s_nationkey AS DOUBLE), 'SUPPLIER', 1, s_suppkey FROM supplier)"""


def trade_edges_sql(strict: bool = False) -> str:
    discount, quantity = (0.095, 50) if strict else (0.09, 45)
    return f"""te AS (
  SELECT row_number() OVER (ORDER BY {", ".join(ORDER)}) - 1 AS eid, 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, l_shipdate AS ts,
         l_extendedprice AS amt, o_orderpriority AS fmt,
         CASE WHEN l_returnflag = 'R' AND l_discount >= CAST({discount} AS DOUBLE) AND l_quantity >= {quantity} THEN 1 ELSE 0 END AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


HOP_EDGES_SQL = """ee AS (SELECT * FROM (
  SELECT event_id AS eid, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, ts, value AS amt, event_type AS fmt,
         CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END AS y FROM events) t WHERE dst IS NOT NULL)"""
