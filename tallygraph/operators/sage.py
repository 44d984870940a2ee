"""Message passing: means over in-edges and dense maps, as joins, aggregates and array expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights that a layer written as expressions may have.
SMALL = 64

def mean_in(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """node and each column's mean over in-edges, parallel ones counted; 0 without in-edges."""
    sent = edges.select("src", "dst").join(nodes.select(F.col("node").alias("src"), *columns), "src")
    mean = sent.groupBy(F.col("dst").alias("node")).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    return nodes.select("node").join(mean, "node", "left").select("node", *[F.coalesce(f"mean_{c}", F.lit(0.0)).alias(f"mean_{c}") for c in columns])


def mapped(df: DataFrame, kept: list[str], inputs: list[str], layers: list[tuple[np.ndarray, np.ndarray, bool]], names: list[str]) -> DataFrame:
    """kept columns (integers, strings) and names: inputs through dense layers (weights, bias, whether negative sums become 0), a matrix product for each batch of rows."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [(f.name, f.dataType.simpleString()) for f in df.select(*kept).schema]
    schema = pa.schema([(n, types[t]) for n, t in fields] + [(n, pa.float64()) for n in names])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(kept) :]], 1) if inputs else np.zeros((batch.num_rows, 0))
            for weights, bias, relu in layers:
                h = h @ weights + bias
                h = np.maximum(h, 0) if relu else h
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(np.ascontiguousarray(x)) for x in h.T)], schema=schema)

    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_{k}") for k, c in enumerate(inputs)]
    return df.select(*kept, *columns).mapInArrow(apply, ", ".join([f"`{n}` {t}" for n, t in fields] + [f"`{n}` double" for n in names]))


def sage_layer(nodes: DataFrame, edges: DataFrame, columns: list[str], w_mean: list[list[float]], w_self: list[list[float]], bias: list[float], *, relu: bool = True) -> DataFrame:
    """node, h0, h1, ...: weights (a row for each output) on the in-edges' mean plus bias plus weights on the node itself, negative sums cut to 0 unless it is the last layer."""
    joined = nodes.select("node", *columns).join(mean_in(nodes, edges, columns), "node")
    weights = np.concatenate([np.asarray(w_mean, float), np.asarray(w_self, float)], 1).T
    if weights.size <= SMALL:  # an expression for each output stays in the JVM
        inputs = [F.col(f"mean_{c}") for c in columns] + [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
        out = [reduce(Column.__add__, [F.lit(float(b)), *(F.lit(float(w)) * x for w, x in zip(own, inputs, strict=True))]) for own, b in zip(weights.T, bias, strict=True)]
        return joined.select("node", *[(F.greatest(F.lit(0.0), z) if relu else z).alias(f"h{k}") for k, z in enumerate(out)])
    return mapped(joined, ["node"], [f"mean_{c}" for c in columns] + columns, [(weights, np.asarray(bias, float), relu)], [f"h{k}" for k in range(len(bias))])


def edge_gather(edges: DataFrame, nodes: DataFrame, columns: list[str], attributes: list[str]) -> DataFrame:
    """eid, both ends' columns (src_, dst_) and the edge's own."""
    a = nodes.select(F.col("node").alias("src"), *[F.col(c).alias(f"src_{c}") for c in columns])
    b = nodes.select(F.col("node").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in columns])
    return edges.select("eid", "src", "dst", *attributes).join(a, "src").join(b, "dst").select("eid", *[f"src_{c}" for c in columns], *[f"dst_{c}" for c in columns], *attributes)
