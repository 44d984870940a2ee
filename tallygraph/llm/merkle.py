"""Merkle manifest of a table: trees of fan-out 8, one for each language, kept as postorder append logs.

A builder takes an aligned block of 8^4 consecutive leaves and appends every node the moment it is complete: a leaf, then the
parents that it completes. So the place of a node follows from the sizes of the subtrees before it (position) without an
index, and a proof reads its siblings at computed places. The roots of the blocks are the leaves of the next tier, built in
the same way, until one block holds a whole tree; the trees' roots in turn are the leaves of one more tree. No builder sees
more than one block, and a proof joins a block's log with the path above the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bounded_batches, record, written

FAN, HEIGHT = 8, 4
#: Leaves of a full block.
BLOCK = FAN**HEIGHT
DIGEST = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parent(run: str) -> bytes:
    """The digest of a run of nodes, whose digests stand end to end as hexadecimal text."""
    return hashlib.sha256(run.encode()).digest()


def levels(leaves: int) -> int:
    """Levels above that many leaves until one node remains."""
    height = 0
    while FAN**height < leaves:
        height += 1
    return height


def appended(leaves: list[bytes], height: int) -> bytes:
    """The log: leaves and inner nodes up to the height, each appended once it is complete."""
    log: list[bytes] = []
    runs: list[list[str]] = [[] for _ in range(height + 1)]

    def append(node: bytes, level: int) -> None:
        log.append(node)
        runs[level].append(node.hex())
        if level < height and len(runs[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        run, runs[level] = "".join(runs[level]), []
        append(parent(run), level + 1)

    for leaf in leaves:
        append(leaf, 0)
    for level in range(height):
        if runs[level]:
            close(level)
    return b"".join(log)


def position(level: int, index: int, leaves: int) -> int:
    """Where the log of so many leaves holds the index-th node of a level: after all nodes completed by its own last leaf's forerunners, and its level above that leaf."""
    last = min((index + 1) * FAN**level, leaves) - 1
    return level + sum(last // FAN**j for j in range(HEIGHT + 1))


def step(log: bytes, leaves: int, level: int, run: int) -> list[bytes]:
    """The nodes of a run, read from the log at their positions."""
    have = -(-leaves // FAN**level)
    places = (position(level, i, leaves) * DIGEST for i in range(run * FAN, min((run + 1) * FAN, have)))
    return [log[p : p + DIGEST] for p in places]


def paths(log: bytes, leaves: int, height: int) -> Iterator[bytes]:
    """For every leaf of a block the way to the block's root: at each level its place in the run, the run's size and the run."""
    held: dict[tuple[int, int], bytes] = {}
    for leaf in range(leaves):
        way = b""
        for level in range(height):
            at, run = leaf // FAN**level, leaf // FAN ** (level + 1)
            if (level, run) not in held:
                nodes = step(log, leaves, level, run)
                held[level, run] = bytes([len(nodes)]) + b"".join(nodes)
            way += bytes([at % FAN]) + held[level, run]
        yield way


def split(way: bytes) -> list[tuple[str, str]]:
    """A path's digests left and right of the own one, as hexadecimal text, level by level."""
    out, at = [], 0
    while at < len(way):
        own, size = way[at], way[at + 1]
        run = way[at + 2 : at + 2 + size * DIGEST].hex()
        out.append((run[: own * 2 * DIGEST], run[(own + 1) * 2 * DIGEST :]))
        at += 2 + size * DIGEST
    return out


def folded(digest: str, way: list[tuple[str, str]]) -> str:
    """The root that a leaf leads to with the siblings of its path."""
    for left, right in way:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def leaf_digest(*columns: Column) -> Column:
    """SHA-256, as bytes, over the columns in turn: the number of UTF-8 bytes, a colon and the value, or a hyphen for null."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows(tree, ...) with rank, from 0 in each tree in the order given, and total, the tree's number of rows.

    Ranges of about equal size are counted within tasks; only a row for each range and tree is added up. Rows must be a stored
    table: their place in it settles ties, so that repeated rows need not meet in one range.
    """
    spread = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_at").sortWithinPartitions("tree", *order, "_at").drop("_at")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tree, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            trees, nth = batch.column("tree").to_pylist(), []
            for t in trees:
                tree, n = t, n + 1 if t == tree else 0
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], [*batch.schema.names, "part", "nth"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    held = written(spread.mapInArrow(count, f"{kinds}, part int, nth long"), "ranges")
    sizes = held.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    before, every = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("tree")
    starts = written(sizes.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(every).alias("total")), "starts")
    return held.join(starts, ["tree", "part"]).withColumn("rank", F.col("start") + F.col("nth")).drop("part", "nth", "start")


BUILT = "tree string, block long, total long, log binary, keys array<{key}>, claims array<binary>"


def built(entries: DataFrame, key: str) -> DataFrame:
    """A row for each block of entries(tree, rank, total, digest, key, claim): its log, and keys and claims in the order of its leaves."""
    spec = BUILT.format(key=key)
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("log", pa.binary())])

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        total, leaves = group["total"][0].as_py(), group["digest"].to_pylist()
        log = appended(leaves, HEIGHT if total > BLOCK else levels(total))
        head = record(schema, [group["tree"][0].as_py()], [group["block"][0].as_py()], [total], [log])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(leaves)], pa.int32()), pa.concat_arrays(group[c].chunks)) for c in ("key", "claim")]
        return pa.Table.from_arrays([*head.columns, *lists], [*schema.names, "keys", "claims"])

    placed = entries.withColumn("block", F.floor(F.col("rank") / BLOCK))
    return written(placed.groupBy("tree", "block").applyInArrow(build, spec), "blocks")


@dataclass(frozen=True)
class Log:
    """tiers: the blocks of leaves, then blocks of block roots, and so on; roots(tree, tier, digest): each tree's root and the tier that holds it."""

    tiers: list[DataFrame]
    roots: DataFrame


def logged(entries: DataFrame, key: str) -> Log:
    """All tiers over ranked entries."""
    tiers = [built(entries, key)]
    while tiers[-1].filter(F.col("total") > BLOCK).limit(1).count():
        more = tiers[-1].filter(F.col("total") > BLOCK)
        over = more.select("tree", F.col("block").alias("rank"), F.ceil(F.col("total") / BLOCK).alias("total"), top().alias("digest"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("binary").alias("claim"))
        tiers.append(built(over, "bigint"))
    ends = [t.filter(F.col("total") <= BLOCK).select("tree", F.lit(k).alias("tier"), top().alias("digest")) for k, t in enumerate(tiers)]
    return Log(tiers, reduce(DataFrame.unionByName, ends))


def top() -> Column:
    """A block's root, the last node to be complete."""
    return F.substring("log", -DIGEST, DIGEST)


def leaves_of(total: int, block: int) -> tuple[int, int]:
    """Leaves and levels of a block of a tier with so many entries."""
    return min(BLOCK, total - block * BLOCK), HEIGHT if total > BLOCK else levels(total)


OPENED = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("subroot", pa.binary()), ("way", pa.binary())])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks with the way above them: the way of each entry, named as the block of the tier below that it is the root of."""
    for batch in batches:
        for r in batch.to_pylist():
            n, height = leaves_of(r["total"], r["block"])
            ways = [w + r["way"] for w in paths(r["log"], n, height)]
            yield record(OPENED, [r["tree"]] * n, range(r["block"] * BLOCK, r["block"] * BLOCK + n), [r["subroot"]] * n, ways)


def below(log: Log, ends: DataFrame) -> DataFrame:
    """tree, block, subroot and way for every block of leaves, from ends(tree, tier, subroot, way) of the trees' roots, tier by tier down."""
    above = None
    for k in range(len(log.tiers) - 1, -1, -1):
        own = ends.filter(F.col("tier") == k).select("tree", F.lit(0).cast("long").alias("block"), "subroot", "way")
        above = own if above is None else own.unionByName(above)
        if k:
            held = log.tiers[k].select("tree", "block", "total", "log").join(above, ["tree", "block"]).select("tree", "block", "total", "log", "subroot", "way")
            above = written(held.mapInArrow(opened, "tree string, block long, subroot binary, way binary"), "ways")
    return above


@dataclass(frozen=True)
class Manifest:
    """The trees over all rows, and the tree over the trees' roots, with the digest of everything."""

    rows: Log
    trees: Log
    root: bytes
    key: str


def manifest(rows: DataFrame, digest: Column, claim: Column, *, tree: str = "lang", key: str = "doc_id") -> Manifest | None:
    """Trees over the digests of rows, one for each value of tree; claim is a digest to be held against the manifest later. None without rows.

    Leaves ascend by key (null first), then by digest, so rows in another order give the same manifest; of repeated rows each
    is a leaf. Values of tree may be null, which comes first, and are ordered by their UTF-8 bytes.
    """
    kind = rows.schema[key].dataType.simpleString()
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))  # '-' is less than '=', so null comes first
    table = written(rows.select(name.alias("tree"), F.col(key).alias("key"), digest.alias("digest"), claim.alias("claim")), "leaves")
    if not table.limit(1).count():
        return None
    log = logged(ranked(table, "key", "digest"), kind)
    roots = written(log.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.lit(None).cast("binary").alias("claim")), "subroots")
    trees = logged(ranked(roots, "key"), "string")
    return Manifest(log, trees, bytes(trees.roots.collect()[0]["digest"]), kind)


PROVED = pa.schema([("leaf", pa.string()), ("subroot", pa.string()), ("proof", pa.string()), ("proof_digests", pa.int32()), ("folded", pa.string())])


def proofs(m: Manifest) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, proof_digests (how many siblings), folded_root (from the claim) and verified for every row of the manifest."""
    whole = m.root.hex()
    start = m.trees.roots.select("tree", "tier", F.col("digest").alias("subroot"), F.lit(b"").alias("way"))
    outer = m.trees.tiers[0].join(below(m.trees, start), ["tree", "block"])

    def hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, height = leaves_of(r["total"], r["block"])
                yield pa.RecordBatch.from_arrays([pa.array(r["keys"], pa.string()), pa.array([w + r["way"] for w in paths(r["log"], n, height)], pa.binary())], ["tree", "way"])

    hang = written(outer.select("total", "block", "log", "keys", "way").mapInArrow(hung, "tree string, way binary"), "hangs")
    ends = m.rows.roots.withColumnRenamed("digest", "subroot").join(hang, "tree")
    inner = m.rows.tiers[0].join(below(m.rows, ends), ["tree", "block"])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                total, block, log, claims, subroot, way = (batch.column(c)[j].as_py() for c in ("total", "block", "log", "claims", "subroot", "way"))
                n, height = leaves_of(total, block)
                over = split(way)
                upper = "".join(left + right for left, right in over)
                out: list[tuple] = []
                for i, own in enumerate(paths(log, n, height)):
                    near, at = split(own), position(0, i, n) * DIGEST
                    siblings = "".join(left + right for left, right in near) + upper
                    leaf = log[at : at + DIGEST].hex()
                    out.append((leaf, subroot.hex(), hashlib.sha256(siblings.encode()).hexdigest(), len(siblings) // (2 * DIGEST), folded(claims[i].hex(), near + over)))
                proved = record(PROVED, *zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("keys")[j].values, *proved.columns], ["key", *PROVED.names])

    columns = ("total", "block", "log", "keys", "claims", "subroot", "way")
    found = inner.select(*columns).mapInArrow(prove, f"key {m.key}, leaf string, subroot string, proof string, proof_digests int, folded string")
    return found.select(
        "key", "leaf", "subroot", F.lit(whole).alias("root"), F.col("proof").alias("proof_sha256"), "proof_digests", F.col("folded").alias("folded_root"), (F.col("folded") == whole).alias("verified")
    )


def verified(docs: DataFrame, presented: Column, *, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, proof_digests, folded_root and verified of documents, each presented with the text given.

    Any of the columns may be null, also doc_id (such leaves come first and are held against the manifest as others are) and
    lang (a tree of its own); empty and very long texts are hashed whole; of repeated rows each is a leaf; extra columns are
    not looked at; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    held = [F.col(c) for c in columns]
    m = manifest(docs, leaf_digest(*held), leaf_digest(*held[:-1], presented))
    if m is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, proof_digests int, folded_root string, verified boolean")
    return proofs(m).withColumnRenamed("key", "doc_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, against texts of which a third have lost their capital letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    out = verified(docs, F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle() -> str:
    """The same with recursion over the levels: nodes of all trees, left and right siblings of each leaf, and folding."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: f"sha256({' || '.join([part(c) for c in COLUMNS[:-1]] + [part(text)])})"
    bits = "list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ord(ch), -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({bits}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c // 2, (c % 2) * 3988292384) END), 4294967295)"
    tree = lambda name, source: f"""{name} AS (SELECT tree, 0 AS level, rank, digest, total FROM {source}
      UNION ALL SELECT tree, level + 1, rank // {FAN}, sha256(string_agg(digest, '' ORDER BY rank)), (total + {FAN - 1}) // {FAN} FROM {name} WHERE total > 1 GROUP BY tree, level, rank // {FAN}, total)"""  # noqa: E731
    sides = lambda name, source, nodes: f"""{name} AS (SELECT s.tree, s.rank, n.level, coalesce(string_agg(n.digest, '' ORDER BY n.rank) FILTER (n.rank < s.rank // CAST(pow({FAN}, n.level) AS BIGINT)), '') AS lefts,
        coalesce(string_agg(n.digest, '' ORDER BY n.rank) FILTER (n.rank > s.rank // CAST(pow({FAN}, n.level) AS BIGINT)), '') AS rights
      FROM {source} s JOIN {nodes} n ON s.tree = n.tree AND n.total > 1 AND n.rank // {FAN} = s.rank // CAST(pow({FAN}, n.level + 1) AS BIGINT) GROUP BY ALL)"""  # noqa: E731
    return f"""WITH RECURSIVE docs AS (SELECT *, {digest("text")} AS digest,
        CASE WHEN {crc} % 3 = 0 THEN {digest(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {digest("text")} END AS claim FROM documents),
    leaves AS MATERIALIZED (SELECT coalesce('=' || lang, '-') AS tree, doc_id, digest, claim, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS total FROM docs),
    {tree("nodes", "leaves")},
    tops AS MATERIALIZED (SELECT '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS total FROM nodes WHERE total = 1),
    {tree("outer_nodes", "tops")},
    {sides("inner_sides", "leaves", "nodes")},
    {sides("outer_sides", "tops", "outer_nodes")},
    ways AS MATERIALIZED (SELECT tree, rank, row_number() OVER (PARTITION BY tree, rank ORDER BY part, level) AS step, lefts, rights FROM (
      SELECT tree, rank, 0 AS part, level, lefts, rights FROM inner_sides
      UNION ALL SELECT l.tree, l.rank, 1, o.level, o.lefts, o.rights FROM leaves l JOIN tops t ON t.name = l.tree JOIN outer_sides o ON o.rank = t.rank)),
    folding AS (SELECT tree, rank, 0 AS step, claim AS digest FROM leaves
      UNION ALL SELECT f.tree, f.rank, f.step + 1, sha256(w.lefts || f.digest || w.rights) FROM folding f JOIN ways w ON w.tree = f.tree AND w.rank = f.rank AND w.step = f.step + 1),
    ended AS (SELECT tree, rank, arg_max(digest, step) AS digest FROM folding GROUP BY ALL),
    proved AS (SELECT tree, rank, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof FROM ways GROUP BY ALL),
    whole AS (SELECT digest AS root FROM outer_nodes WHERE total = 1)
    SELECT doc_id, l.digest AS leaf, t.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, e.digest AS folded_root, e.digest = root AS verified
    FROM leaves l JOIN tops t ON t.name = l.tree JOIN ended e ON e.tree = l.tree AND e.rank = l.rank LEFT JOIN proved p ON p.tree = l.tree AND p.rank = l.rank, whole"""
