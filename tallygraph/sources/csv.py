"""Transaction and account files, and property graphs stored as Parquet."""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import TIMESTAMP, finite, normal_names, parsed_time, resized
from ..graph import PropertyGraph, freed, numbered, numbered_lines, shared_folder, stored
from ..operators import splits

#: Header of the transaction file by position; "Account" stands there twice, so the schema is given, not read.
TRANSACTIONS = (
    "`timestamp` STRING, `from_bank` STRING, `src` STRING, `to_bank` STRING, `dst` STRING, `amount_received` STRING, "
    "`receiving_currency` STRING, `amt` STRING, `payment_currency` STRING, `fmt` STRING, `label` STRING"
)
FLOOR = 10_000
#: Lines of a packed file, which one task reads.
LINES = 1_000_000


@dataclass(frozen=True)
class Paths:
    transactions: str
    accounts: str


def resolve_paths(spark: SparkSession, folder: str, transactions: str = "HI-Small_Trans.csv", accounts: str = "HI-Small_accounts.csv") -> Paths:
    """Both files of a folder, in any store Spark reads; FileNotFoundError names the missing one."""
    found = Paths(f"{folder}/{transactions}", f"{folder}/{accounts}")
    for path in (found.transactions, found.accounts):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(path)
    return found


def download(*_: object) -> None:
    raise NotImplementedError("datasets are not downloaded; put the CSV files into a folder and pass it")


def read_transactions(spark: SparkSession, path: str, *, prefix: int | None = None, window: int | None = None, lenient: bool = False) -> DataFrame:
    """eid, src, dst, ts, amt, fmt, from_bank, to_bank, y in order of files by name and of lines in them.

    prefix keeps the first rows (None or less than 1: all), window the first max(10,000, window). lenient skips rows with
    too few columns, which count toward the window, and reads blank amounts and labels as 0; otherwise a label that is no
    number is an error. A slice counts the rows of the files' parts first and numbers only the parts that it needs.
    """
    limit = max(FLOOR, window) if window else prefix if prefix and prefix > 0 else None
    schema = TRANSACTIONS + (", `_broken` STRING" if lenient else "")
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("columnPruning", not lenient).csv(path)
    part = F.struct("_metadata.file_path", "_metadata.file_block_start")
    rows = rows.select("*", part.alias("_part"), F.monotonically_increasing_id().alias("_line"))
    if limit:
        sizes = sorted(((r["_part"], r["n"]) for r in rows.select("_part", "src", *["_broken"] * lenient).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: tuple(x[0]))
        reached = next((k for k, total in enumerate(accumulate(n for _, n in sizes)) if total >= limit), len(sizes) - 1)
        if sizes:
            last = sizes[reached][0]
            rows = rows.filter(F.col("_part") <= F.struct(F.lit(last["file_path"]).alias("file_path"), F.lit(last["file_block_start"]).cast("long").alias("file_block_start")))
    used = ("timestamp", "src", "dst", "amt", "fmt", "from_bank", "to_bank", "label", *["_broken"] * lenient)
    rows = numbered_lines(stored(rows.select(*used, "_part", "_line")), "_part", "_line", name="eid")
    rows = rows.filter(F.col("eid") < limit) if limit else rows
    number = lambda c: finite(F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    label, amount = F.col("label").cast("int"), number("amt")
    if lenient:
        rows = rows.filter(F.col("_broken").isNull() | (F.size(F.split("_broken", ",")) >= len(TRANSACTIONS.split(","))))
        label, amount = F.expr("coalesce(try_cast(label AS INT), 0)"), F.coalesce(amount, F.lit(0.0))
    return rows.select("eid", "src", "dst", parsed_time(F.col("timestamp")).alias("ts"), amount.alias("amt"), F.coalesce("fmt", F.lit("nan")).alias("fmt"), number("from_bank").alias("from_bank"), number("to_bank").alias("to_bank"), label.alias("y"))


def write_transactions(edges: DataFrame, cut: Column | None = None) -> str:
    """Edges (eid, src, dst, ts, amt, fmt, y) as transaction files in the shared folder, in order of eid along the files' names; returns their folder.

    Files are packed, of at most LINES lines as only whole ones can be unpacked; with a cut they are plain. Values hold no commas or quotes. Lines where cut holds end after the first account, as broken files have it.
    """
    folder = shared_folder(edges.sparkSession, "transactions")
    text = {"timestamp": F.date_format("ts", TIMESTAMP), "src": F.col("src"), "dst": F.col("dst"), "amt": F.col("amt"), "fmt": F.col("fmt"), "label": F.col("y")}
    names = [part.split("`")[1] for part in TRANSACTIONS.split(",")]
    rows = edges.repartitionByRange("eid").sortWithinPartitions("eid")
    if cut is None:
        rows.select(*[text.get(n, F.lit(1)).cast("string").alias(n) for n in names]).write.option("header", True).option("compression", "gzip").option("maxRecordsPerFile", LINES).csv(folder)
        freed(edges.sparkSession, folder)
        return folder
    fields = [F.coalesce(text.get(n, F.lit(1)).cast("string"), F.lit("")) for n in names]
    line = F.concat_ws(",", F.when(cut, F.array(*fields[:3])).otherwise(F.array(*fields)))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # each file begins with its header
    headed = rows.select(line.alias("value"), first.alias("_first")).withColumn("value", F.when(F.col("_first"), F.concat(F.lit(",".join(names) + "\n"), "value")).otherwise(F.col("value")))
    headed.select("value").write.text(folder)
    return folder


def write_accounts(accounts: DataFrame, *order: str) -> str:
    """Accounts (account_id, bank, name) as account files in the shared folder, in the order given along the files' names; returns their folder."""
    folder = shared_folder(accounts.sparkSession, "accounts")
    rows = accounts.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(F.col("account_id").alias("Account Number"), F.col("bank").alias("Bank ID"), F.col("name").alias("Entity Name")).write.option("header", True).csv(folder)
    return folder


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """account_id, bank and name, with a row id in order of files by name and of lines in them; names of columns are matched stripped and lower-cased."""
    read = spark.read.option("header", True).csv(path)
    part = F.struct("_metadata.file_path", "_metadata.file_block_start")
    rows = read.select("*", part.alias("_part"), F.monotonically_increasing_id().alias("_line"))
    used = normal_names(rows).select("account number", "bank id", "entity name", "_part", "_line")
    rows = numbered_lines(stored(used), "_part", "_line", name="row_id")
    return rows.select("row_id", F.col("account number").alias("account_id"), finite(F.expr("try_cast(`bank id` AS DOUBLE)")).alias("bank"), F.col("entity name").alias("name"))


def read_graph(spark: SparkSession, folder: str, *, node_width: int, edge_width: int, seed: int = 7) -> PropertyGraph:
    """A stored graph made to conform: narrower node vectors padded, missing edge vectors zero, splits drawn where it has none; wider vectors or dangling ends are errors.

    Vectors may be stored as such (x, edge_attr) or as the columns that its meta names.
    """
    nodes, edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    held = spark.read.text(f"{folder}/meta").collect()
    meta = json.loads(held[0][0]) if held else {}
    nodes, edges = as_vector(nodes, "x", meta.get("node_columns")), as_vector(edges, "edge_attr", meta.get("edge_columns"))
    if not {"node", "x", "y"} <= set(nodes.columns) or not {"src", "dst", "y"} <= set(edges.columns):
        raise TypeError(f"{folder} holds no property graph")
    if nodes.filter(F.size("x") > node_width).limit(1).count():
        raise ValueError(f"node vectors are wider than {node_width}")
    if "edge_attr" not in edges.columns:
        edges = edges.withColumn("edge_attr", F.array().cast("array<float>"))
    elif edges.filter(F.size("edge_attr") != edge_width).limit(1).count():
        raise ValueError(f"edge vectors are not {edge_width} wide")
    if edges.join(nodes, edges["src"] == nodes["node"], "left_anti").limit(1).count() or edges.join(nodes, edges["dst"] == nodes["node"], "left_anti").limit(1).count():
        raise ValueError("an edge ends at no node")
    if "eid" not in edges.columns:
        edges = numbered(edges, None, "src", "dst", "y", name="eid")
    nodes = nodes if "split" in nodes.columns else splits.split(nodes, seed, key="node")
    edges = edges if "split" in edges.columns else splits.split(edges, seed + 1, key="eid")
    return PropertyGraph(nodes.withColumn("x", resized(F.col("x"), node_width)), edges.withColumn("edge_attr", resized(F.col("edge_attr"), edge_width)), meta)


def as_vector(df: DataFrame, name: str, columns: list[str] | None) -> DataFrame:
    """df with the columns as one vector, unless it has that already or lacks one of them."""
    if name in df.columns or columns is None or not set(columns) <= set(df.columns):
        return df
    return df.withColumn(name, F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in columns]) if columns else F.array().cast("array<float>")).drop(*columns)


def as_columns(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """df with a vector's components as columns in place of it."""
    return df.select(*[c for c in df.columns if c != name], *[F.coalesce(F.get(name, F.lit(k)).cast("double"), F.lit(0.0)).alias(c) for k, c in enumerate(columns)])


def write_graph(graph: PropertyGraph, folder: str) -> None:
    """nodes and edges as Parquet, meta as one line of JSON."""
    spark = graph.nodes.sparkSession
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    spark.createDataFrame([(json.dumps(graph.meta, allow_nan=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
