"""Structured Streaming entry point: degrees of a growing edge table.

The operators are batch operators; what streams naturally is the sum behind most of them, the degree count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame) -> DataFrame:
    """node, in_deg, out_deg of a streaming (or batch) DataFrame of edges (src, dst), for output mode complete or update; parallel edges count."""
    end = lambda c, i, o: F.struct(F.col(c).alias("node"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select(F.explode(F.array(end("src", 0, 1), end("dst", 1, 0))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
