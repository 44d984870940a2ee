"""A property graph as two lazy DataFrames, and the few operations everything else is made of."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    """nodes(node, y, ...) and edges(eid, src, dst, y, ...), directed, with parallel edges and self-loops."""

    nodes: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below that of spark.checkpoint.dir, which all executors share; where that is unset and all runs on one machine, below one of our own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallygraph-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows in the shared folder: iterative plans stay short and survive lost executors."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint()


#: Rows that one task numbers, about.
NUMBERED = 1_000_000
#: Rows that an ordered limit, which ends in one task, may have.
TOP = 100_000


def hash_digits(rows: int) -> int:
    """Leading hexadecimal digits of a hash that make buckets of about NUMBERED rows, two at least."""
    return max(2, math.ceil(math.log(max(rows, 1) / NUMBERED, 16))) if rows > NUMBERED else 2


#: Bytes of a stored table from which the shuffles behind it are worth freeing.
FREED = 16 << 20


_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted at the end; lasting ones pass on to the context around, if any. What is read after it must not come from the others."""
    _passing.append([])
    try:
        yield
    finally:
        for at in _passing.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, *, lasting: bool = False) -> DataFrame:
    """Rows as a Parquet table in the shared folder, whose readers take the columns they need; unlike those of a checkpoint they come back in any partitions.

    Executors delete a shuffle's files once the driver has collected its last reference, which may take hours; behind a large
    table the driver collects at once, so that the disk holds one table's shuffles at a time.
    """
    at = shared_folder(df.sparkSession, "rows")
    for tables in _passing[:-1][-1:] if lasting else _passing[-1:]:
        tables.append(at)
    df.write.parquet(at)
    freed(df.sparkSession, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def freed(spark: SparkSession, at: str) -> None:
    """Frees the shuffles behind what was written to a folder, if that is large."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() >= FREED:
        spark._jvm.System.gc()


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with _bucket: ranges of about equal size along the order, which never decrease along it; a table in the shared folder, as ranges are drawn from a sample."""
    return stored(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()))


#: Of a row's place: the bits below the number of its range, as monotonically_increasing_id has them.
WITHIN = 33
#: Buckets whose first numbers one task may add up.
BUCKETS = 100_000


def numbered(df: DataFrame, bucket: Column | None, *order: Column | str, name: str, buckets: int = 0, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows numbered from 0 in the order given, of which only the columns to keep (all, if None) are stored and returned.

    Without a bucket the rows are sorted within ranges of about equal size, whatever their values, and stored with their place
    in the range; a range's first number is the rows of those before it, and only a row for each range meets in one task.
    A bucket, which never decreases along the order, saves the store, for orders by a hash: its rows are numbered in one task
    each. Where there may be more than BUCKETS of them (buckets, about), their first numbers are added up over ranges too.
    Rows are dealt by bucket before expressions of the order are computed, so a hash to sort by is not shuffled.
    """
    kept = df.columns if keep is None else list(keep)
    if bucket is None:
        held = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias("_at")))
        held = held.withColumn("_bucket", F.shiftright("_at", WITHIN)).withColumn("_nth", F.col("_at").bitwiseAND((1 << WITHIN) - 1)).drop("_at")
    else:
        nth = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
        placed = df.withColumn("_bucket", bucket)
        held = placed.repartition("_bucket").select(*kept, "_bucket", (nth.cast("long") - 1).alias("_nth"))
    sizes = (held if bucket is None else placed).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = running(sizes, "_bucket", "_n", "_start", buckets > BUCKETS)
    starts = F.broadcast(starts) if bucket is None else starts  # a row for each range
    return held.join(starts, "_bucket").withColumn(name, F.col("_start") + F.col("_nth")).drop("_bucket", "_nth", "_start")


def numbered_lines(rows: DataFrame, part: str, line: str, *, name: str) -> DataFrame:
    """Stored rows numbered from 0 in the order of their parts and lines. A part's lines have successive numbers, so only a row for each part meets in one task, and nothing is sorted."""
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), F.min(line).alias("_least"))
    before = F.sum("_n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(part, (F.coalesce(before, F.lit(0)) - F.col("_least")).alias("_shift"))
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(line) + F.col("_shift")).drop(part, line, "_shift")  # a row for each part


def running(rows: DataFrame, key: str, amount: str, name: str, many: bool) -> DataFrame:
    """key and name, the sum of amount over smaller keys; many: in ranges of the key, whose totals are added up first."""
    before = lambda *within: W.partitionBy(*within).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    upto = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    if not many:
        return rows.select(key, upto(amount, before()).alias(name))
    held = stored(rows.select(key, amount).repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    totals = held.groupBy("_range").agg(F.sum(amount).alias("_all"))
    ahead = totals.select("_range", upto("_all", W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_ahead"))
    return held.withColumn("_own", upto(amount, before("_range"))).join(F.broadcast(ahead), "_range").select(key, (F.col("_ahead") + F.col("_own")).alias(name))  # a row for each range


def first(df: DataFrame, rows: int, *order: Column | str) -> DataFrame:
    """The first rows in the order: a top-k while they are few, else by number, so that they never meet in one task."""
    if rows <= TOP:
        return df.orderBy(*order).limit(max(rows, 0))
    return numbered(df, None, *order, name="_number").filter(F.col("_number") < rows).drop("_number")


def shuffled(df: DataFrame, key: Column, *ties: str, name: str, rows: int | None = None) -> DataFrame:
    """Rows numbered from 0 in the order of a hexadecimal hash, whose first digits are the buckets: as many as the rows need, which are counted unless given."""
    digits = hash_digits(df.count() if rows is None else rows)
    return numbered(df, leading(key, digits), key, *ties, name=name, buckets=16**digits)


def leading(key: Column, digits: int) -> Column:
    """The first digits of a hexadecimal hash as a number."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def induced(edges: DataFrame, kept: DataFrame, node: str = "node") -> DataFrame:
    """Edges whose both ends are kept."""
    ids = kept.select(F.col(node).alias("_id")).distinct()
    return edges.join(ids, edges["src"] == ids["_id"], "left_semi").join(ids, F.col("dst") == F.col("_id"), "left_semi")


def relabelled(edges: DataFrame, ids: DataFrame, few: bool = False) -> DataFrame:
    """Edges with their ends replaced through ids(node, idx), which are sent to the edges if few."""
    ids = F.broadcast(ids) if few else ids
    a, b = ids.select(F.col("node").alias("src"), F.col("idx").alias("_s")), ids.select(F.col("node").alias("dst"), F.col("idx").alias("_d"))
    return edges.join(a, "src").join(b, "dst").withColumn("src", F.col("_s")).withColumn("dst", F.col("_d")).drop("_s", "_d")


def symmetrised(edges: DataFrame) -> DataFrame:
    """Both directions of every edge but self-loops, parallel ones kept."""
    plain = edges.filter("src <> dst")
    return plain.select("src", "dst").unionAll(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def simple(edges: DataFrame, max_edges: int | None = None) -> DataFrame:
    """The undirected simple projection (u < v) of the first max_edges edges by eid."""
    held = edges if max_edges is None else edges.filter(F.col("eid") < max_edges)
    return held.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def neighbours(pairs: DataFrame) -> DataFrame:
    """Both directions of an undirected simple graph."""
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(pairs.select(F.col("v").alias("node"), F.col("u").alias("other")))


#: Neighbours that one block of a node's list holds, about; and nodes of several blocks that may be broadcast, some 40 bytes each.
HUB, BROADCAST = 2048, 500_000


@dataclass(frozen=True)
class Adjacency:
    """Lists of neighbours in blocks of about HUB, so that a hub's list is many tasks' work: blocks(at, block, ...), stored by at and block.

    hubs(at, blocks) are the nodes of several blocks; None if there is none.
    """

    blocks: DataFrame
    hubs: DataFrame | None

    @classmethod
    def over(cls, links: DataFrame, hub: int = HUB) -> Adjacency:
        """Of stored links(at, node, ...), which are dealt anew by each search that meets many of them."""
        many = checkpointed(links.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("blocks")).filter("blocks > 1"))
        n = many.count()
        hubs = (F.broadcast(many) if n <= BROADCAST else many) if n else None
        block = F.pmod(F.xxhash64(*[c for c in links.columns if c != "at"]), F.col("blocks")).cast("int")
        return cls(links.withColumn("block", F.lit(0)) if hubs is None else links.join(hubs, "at", "left").withColumn("block", F.coalesce(block, F.lit(0))).drop("blocks"), hubs)

    @classmethod
    def of(cls, links: DataFrame, *, distinct: bool = True, hub: int = HUB) -> Adjacency:
        """From links(at, node, ...): written once, as every wave of a search joins it there; each row once if distinct."""
        found = cls.over(links, hub)
        dealt = found.blocks.repartition("at", "block")
        return cls(checkpointed(dealt.dropDuplicates() if distinct else dealt), found.hubs)

    def copied(self, rows: DataFrame) -> DataFrame:
        """rows(at, ...) with block: a hub's rows once for each of its blocks."""
        if self.hubs is None:
            return rows.withColumn("block", F.lit(0))
        every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        return rows.join(self.hubs, "at", "left").withColumn("block", every).drop("blocks")

    def met(self, rows: DataFrame) -> DataFrame:
        """rows(at, ...), each once for every neighbour of at, with the neighbour's columns; a hub's rows are copied to its blocks."""
        return self.copied(rows).join(self.blocks, ["at", "block"]).drop("block")

    def given(self, rows: DataFrame, values: DataFrame, *by: str) -> DataFrame:
        """rows(at, ...) joined with values(at, ...), one row for each at: a hub's rows are dealt to its blocks by a hash of the columns named."""
        block = F.pmod(F.xxhash64(*by), F.coalesce("blocks", F.lit(1))).cast("int")
        dealt = rows.withColumn("block", F.lit(0)) if self.hubs is None else rows.join(self.hubs, "at", "left").withColumn("block", block).drop("blocks")
        return dealt.join(self.copied(values), ["at", "block"]).drop("block")


def both_ways(edges: DataFrame) -> DataFrame:
    """at and node: every edge from each of its ends."""
    return edges.select(F.col("src").alias("at"), F.col("dst").alias("node")).unionAll(edges.select("dst", "src"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).distinct()


def empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)
