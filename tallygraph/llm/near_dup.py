"""Near-duplicate documents by bottom-k sketches.

One hash function orders all shingles; a document's sketch is its k least values. Inverted lists of retained values give
the documents that overlap; an estimate on the union of two sketches filters the pairs; the Jaccard similarity of the
full sets decides. Documents with equal sets are one class from the start, and only classes are compared.

A list's key is a run of consecutive retained values, so that a boilerplate passage alone rarely makes one. In a long list
documents are first compared, over many tasks, with some of its own, the pivots; those that no pivot leads, with leaders,
which are unlike each other. So copies of a template cost a few comparisons each. A list passes on a spanning forest of the pairs that pass the filter, not the pairs: the forests' components are groups that no
link leaves. Each group's texts then meet once, heavy groups in pairs of blocks, where all pairs that are not linked yet
are verified on the full sets and a spanning forest of the links remains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernel import U64, buffers, distinct_per_owner, mix, shingle_hashes, word_hashes
from .shared import bounded_batches, machine, pieces, record, width, written

#: Words of a shingle, and hundredths of the union that linked sets share.
WORDS, SIMILARITY = 5, 80
#: Values of a sketch.
RETAINED = 64
#: Least values of a sketch that make lists, and the length of a run. Sets of at most so many shingles always share a run if
#: they are linked; larger ones at exactly the least similarity do not with a probability of 2e-5 (0.85) or 5e-5 (0.8).
LISTED, RUN = 14, 2
#: Documents of a list that are compared all with all.
LONG = 256
#: Estimates are within 0.045 of the truth in two of three cases; pairs below this are not verified.
ESTIMATED = 0.6
#: Share of a sketch's values that another one has too if the pair passes the estimate: as many as of the union at least.
LEAST = 0.59
#: In long lists documents are compared with leaders; each other one passes the estimate with a leader, so is within 0.4 of
#: it, and a document linked with it (0.2 apart at most) within 0.6; this is below 0.4 by as much as estimates err.
LED = 0.25
#: Pivots of a long list, about, and documents that one task compares with them.
PIVOTS, DEALT = 64, 4096
#: Shingles of a group's texts that one task holds; a heavier group is dealt in pairs of blocks.
HEAVY = 1 << 22
#: Columns of a table of exact intersections, and pairs from which a block's are counted by one.
COLUMNS, MANY = 1 << 15, 500


class Forest:
    """Disjoint sets."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def sets_of(column: pa.Array, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ranges of the texts in turn: the sorted distinct shingle hashes, end to end, and the offsets of the texts."""
    data, at = buffers(column)
    for a, b in pieces(np.diff(at).tolist()):
        hashes, first = word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a])
        yield distinct_per_owner(*shingle_hashes(hashes, first, words), b - a)


def digest_of(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values, digest_size=16).digest()


def text_digest(text: Column) -> Column:
    """SHA-256 of a text as bytes, null for null."""
    return F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_sha256")


def sketches(docs: DataFrame, *, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (size of the set), digest (of the set), sketch (up to RETAINED ascending 32-bit values) and text_sha256 (as bytes)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("text_sha256", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine(("sketch",))
        for batch in batches:
            sizes, digests, kept = [], [], []
            for values, at in sets_of(batch.column(1), words):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    sizes.append(b - a)
                    digests.append(digest_of(values[a:b]))
                    kept.append((values[a : min(b, a + RETAINED)] >> U64(32)).astype(np.uint32).tobytes())
            yield record(schema, batch.column(0), sizes, digests, kept, batch.column(2))

    bounded_batches(docs.sparkSession)
    named = docs.select(id_col, text_col, text_digest(F.col(text_col)))
    return named.mapInArrow(sketch, "doc_id long, n long, digest binary, sketch binary, text_sha256 binary")


def keys(classes: DataFrame, values: int, run: int) -> DataFrame:
    """key and id: a row for each run of consecutive values among the first ones of a sketch."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])
    weights = mix(np.arange(1, run + 1, dtype=U64)) | U64(1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            held, at = data.view(np.uint32).astype(U64), at // 4
            runs = np.maximum(np.minimum(np.diff(at), values) - run + 1, 0)
            start = np.repeat(at[:-1] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
            key = np.zeros(len(start), U64)
            for j in range(run):
                key += held[start + j] * weights[j]
            yield record(schema, mix(key).view(np.int64), np.repeat(batch.column(0).to_numpy(), runs))

    return classes.select("id", "sketch").mapInArrow(emit, "key long, id long")


def similarity_estimates(held: list[np.ndarray]) -> np.ndarray:
    """Estimated Jaccard similarity of all pairs of sketches: common values by the values of the union up to the lower of both last ones."""
    m = len(held)
    lengths = np.array([len(s) for s in held])
    flat = np.concatenate(held)
    owner = np.repeat(np.arange(m), lengths)
    names = np.unique(flat, return_inverse=True)[1]
    shared = np.bincount(names)[names] > 1
    compact, cells = np.unique(names[shared], return_inverse=True)
    table = np.zeros((m, len(compact)), np.float32)
    table[owner[shared], cells] = 1
    common = table @ table.T
    last = np.array([s[-1] if len(s) >= RETAINED else 2**32 for s in held], np.int64)
    upto = np.stack([np.searchsorted(s, last, side="right") for s in held], 1)  # [i, j]: values of j up to the last of i
    lower = last[:, None] <= last[None, :]
    both = np.where(lower, lengths[:, None] + upto, lengths[None, :] + upto.T)
    return common / np.maximum(both - common, 1)


def listed_pairs(postings: DataFrame) -> DataFrame:
    """a and b: for each list a spanning forest of the pairs that pass the estimate. Rows (key, id, sketch) come sorted by key; lists over LONG go by leaders."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(ids: list[int], held: list[np.ndarray]) -> list[tuple[int, int]]:
        i, j = np.nonzero(np.triu(similarity_estimates(held) >= ESTIMATED, 1))
        forest = Forest()
        return [(ids[x], ids[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]

    def led(ids: list[int], held: list[np.ndarray], leaders: list[int], theirs: list[np.ndarray], forest: Forest) -> list[tuple[int, int]]:
        out = []
        for k in range(0, len(leaders), LONG):
            estimates = similarity_estimates([*held, *theirs[k : k + LONG]])[: len(held), len(held) :]
            i, j = np.nonzero(estimates >= LED)
            out += [(ids[x], leaders[k + y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(ids[x], leaders[k + y])]
            near = estimates.max(1) >= ESTIMATED
            ahead = near if k == 0 else ahead | near
        own = similarity_estimates(held)
        new: list[int] = []
        for x in range(len(ids)):
            near = [y for y in new if own[x, y] >= LED]
            out += [(ids[x], ids[y]) for y in near if forest.join(ids[x], ids[y])]
            if not (len(leaders) and ahead[x]) and not any(own[x, y] >= ESTIMATED for y in near):
                new.append(x)
        leaders += [ids[x] for x in new]
        theirs += [held[x] for x in new]
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, leaders, theirs, forest = None, [], [], [], [], Forest()
        out: list[tuple[int, int]] = []

        def close() -> None:
            if leaders:
                out.extend(led(ids, held, leaders, theirs, forest))
            elif len(ids) > 1:
                out.extend(compared(ids, held))
            for x in (ids, held, leaders, theirs, forest.parent):
                x.clear()

        for batch in batches:
            for k, name, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    close()
                    key = k
                elif len(ids) >= LONG:
                    out.extend(led(ids, held, leaders, theirs, forest))
                    ids.clear()
                    held.clear()
                ids.append(name)
                held.append(np.frombuffer(sketch, np.uint32))
            if len(out) > 20_000:
                yield record(schema, [a for a, _ in out], [b for _, b in out])
                out.clear()
        close()
        yield record(schema, [a for a, _ in out], [b for _, b in out])

    return postings.mapInArrow(compare, "a long, b long")


def pivoted(members: DataFrame) -> DataFrame:
    """key, id, pivot: for rows (key, salt, leads, id, sketch) that come sorted, pivots first, a spanning forest of each list's documents and pivots that are alike; a null pivot tells that none leads."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("pivot", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots, theirs, ids, held, forest = None, [], [], [], [], Forest()
        out: list[tuple[int, int, int | None]] = []

        def meet() -> None:
            if ids:
                near = similarity_estimates([*held, *theirs])[: len(held), len(held) :] if pivots else np.zeros((len(held), 1))
                i, j = np.nonzero(near >= LED)
                out.extend((group[0], ids[x], pivots[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(ids[x], pivots[y]))
                out.extend((group[0], ids[x], None) for x in np.flatnonzero(near.max(1) < ESTIMATED).tolist())
            ids.clear()
            held.clear()

        for batch in batches:
            for key, salt, leads, name, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, salt) != group:
                    meet()
                    for x in (pivots, theirs, forest.parent):
                        x.clear()
                    group = key, salt
                (pivots if leads else ids).append(name)
                (theirs if leads else held).append(np.frombuffer(sketch, np.uint32))
                if len(ids) >= LONG:
                    meet()
            if len(out) > 20_000:
                yield record(schema, *map(list, zip(*out, strict=True)))
                out.clear()
        meet()
        yield record(schema, *(list(c) for c in zip(*out, strict=True)) if out else ([], [], []))

    return members.mapInArrow(compare, "key long, id long, pivot long")


def rare_lists(members: DataFrame) -> DataFrame:
    """key, id, many: the members (key, id, sketch) of each list dealt anew, by those of a sketch's values that fewest of the list have.

    Sketches that pass the estimate share at least LEAST of their values. So of the others there is one too few to fill the
    first values of both in any common order, and the rarest value they share is among both's first ones. Documents that only
    have a passage in common, which is what their list is about, part here: their own values are rarer than the passage's.
    """
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("first", pa.int32()), ("value", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(2))
            many = np.diff(at) // 4
            first = many - (LEAST * many).astype(np.int64) + 1
            yield record(schema, np.repeat(batch.column(0).to_numpy(), many), np.repeat(batch.column(1).to_numpy(), many), np.repeat(first, many), data.view(np.uint32).astype(np.int64))

    values = written(members.select("key", "id", "sketch").mapInArrow(spread, "key long, id long, first int, value long"), "values")
    counts = values.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(W.partitionBy("key", "id").orderBy("n", "value"))
    rarest = values.join(counts, ["key", "value"]).withColumn("nth", nth).filter((F.col("nth") <= F.col("first")) & (F.col("n") > 1))
    lists = written(rarest.select(F.xxhash64("key", "value").alias("key"), "id"), "rare")
    return lists.join(lists.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "key")


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct pairs of classes that join all that share a list and pass the estimate."""
    sketch = classes.select("id", "sketch")
    rows = written(keys(classes, LISTED, RUN), "keys")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    pairs = pairs_of_lists(written(rows.join(sizes, "key"), "lists"), sketch, again=True)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pairs_of_lists(listed: DataFrame, sketch: DataFrame, *, again: bool) -> DataFrame:
    """a and b: spanning forests of the pairs that pass the estimate, for lists (key, id, many). Of a long list what no pivot leads is dealt anew by its rare values, once, if that is many too."""
    parts = width(sketch.sparkSession)
    long = listed.filter(F.col("many") > LONG).join(sketch, "id").withColumn("salts", F.ceil(F.col("many") / DEALT).cast("int"))
    drawn = F.pmod(F.xxhash64("id", F.lit("pivot")), F.ceil(F.col("many") / PIVOTS)) == 0
    pivots = long.filter(drawn).select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("leads"), "id", "sketch")
    members = long.select("key", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("leads"), "id", "sketch")
    met = written(pivoted(pivots.unionByName(members).repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", F.desc("leads"), "id")), "pivoted")
    pairs = met.filter("pivot IS NOT NULL").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    unled = met.filter("pivot IS NULL").select("key", "id")
    crowded = unled.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > LONG).select("key")
    if again and crowded.limit(1).count():
        crowded = written(crowded, "crowded")
        anew = rare_lists(unled.join(crowded, "key", "left_semi").join(sketch, "id"))
        pairs = pairs.unionByName(pairs_of_lists(written(anew, "lists"), sketch, again=False))
        unled = unled.join(crowded, "key", "left_anti")
    rest = listed.filter(F.col("many") <= LONG).select("key", "id").unionByName(unled)
    postings = rest.join(sketch, "id").select("key", "id", "sketch")
    return pairs.unionByName(listed_pairs(postings.repartition(parts, "key").sortWithinPartitions("key", "id")))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all pairs' intersections: products of tables of the members that two or more sets have."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    alone = first & np.append(first[1:], True)
    name = np.cumsum(first & ~alone)[~alone] - 1
    owner, out = owner[~alone], np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(name[-1]) + 1 if len(name) else 0, COLUMNS):
        a, b = np.searchsorted(name, (at, at + COLUMNS))
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[owner[a:b], name[a:b] - at] = 1
        out += (table @ table.T).astype(np.int64)
    return out


def linked(ids: list[int], sets: list[np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets. Only pairs whose estimate passes and whom links do not yet connect are verified."""
    order = sorted((k for k in range(len(ids)) if len(sets[k])), key=lambda k: (len(sets[k]), ids[k]))
    ids, sets = [ids[k] for k in order], [sets[k] for k in order]
    sketch, size = [(s[:RETAINED] >> U64(32)).astype(np.uint32) for s in sets], np.array([len(s) for s in sets])
    forest, out, half = Forest(), [], LONG // 2

    def is_link(both: int, x: int, y: int) -> bool:
        return 100 * both >= similarity * (int(size[x]) + int(size[y]) - both)

    for a in range(0, len(ids), half):
        for b in range(a, len(ids), half):
            if 100 * size[min(a + half, len(ids)) - 1] < similarity * size[b]:
                break  # all further sets are too large for these
            rows = [*range(a, min(a + half, len(ids)))] + ([*range(b, min(b + half, len(ids)))] if b > a else [])
            i, j = np.nonzero(np.triu(similarity_estimates([sketch[k] for k in rows]) >= ESTIMATED, 1))
            todo = [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.find(rows[x]) != forest.find(rows[y])]
            counted = intersections([sets[k] for k in rows]) if len(todo) > MANY else None
            for x, y in todo:
                p, q = rows[x], rows[y]
                if forest.find(p) != forest.find(q):
                    both = int(counted[x, y]) if counted is not None else len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                    if is_link(both, p, q):
                        forest.join(p, q)
                        out.append((ids[p], ids[q]))
    return out


def verified(docs: DataFrame, groups: DataFrame, *, similarity: int = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a and b: a spanning forest of the links of each group, given by id, doc_id, digest, n and component.

    A group's texts come together once; one of over HEAVY shingles is dealt in pairs of blocks. A text of a doc_id whose
    set has another digest than the class is of another class and passed over.
    """
    weight = groups.groupBy("component").agg((F.ceil(F.sum("n") * 2 / HEAVY)).cast("int").alias("blocks"))
    sized = groups.join(weight, "component").withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    asked = sized.select("component", "id", "doc_id", "digest", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = asked.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "doc_id", "digest")
    rows = keyed.join(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id").select("component", "i", "j", "id", "digest", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []
        out: list[tuple[int, int]] = []
        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            for values, at in sets_of(batch.column(5), words):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    *group, name, digest = next(names)
                    if group != key:
                        out += linked(ids, sets, similarity)
                        key, ids, sets = group, [], []
                    if name not in ids[-1:] and digest == digest_of(values[a:b]):  # a repeated row comes next to its like
                        ids.append(name)
                        sets.append(values[a:b].copy())
            yield record(schema, [x for x, _ in out], [y for _, y in out])
            out = []
        out += linked(ids, sets, similarity)
        yield record(schema, [x for x, _ in out], [y for _, y in out])

    dealt = rows.repartition(width(docs.sparkSession), "component", "i", "j").sortWithinPartitions("component", "i", "j", "id")
    return dealt.mapInArrow(verify, "a long, b long").filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of all ids in links (a, b): least labels of neighbours, then labels of labels, until nothing changes.

    Rounds grow with the logarithm of a chain's length; each is a table in the shared folder.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "id").select("id", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        roots = lower.select(F.col("id").alias("component"), F.col("component").alias("root"))
        after = written(lower.join(roots, "component").select("id", "was", F.least("root", "component").alias("component")), "labels")
        if not after.filter("component <> was").limit(1).count():
            return after.select("id", "component")
        labels = after.select("id", "component")


def near_duplicates(docs: DataFrame, *, similarity: int = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row doc_id, n_shingles, component_id (least id reachable over links), kept (whether that is its own) and text_sha256.

    A null, empty or blank text has no shingles and is linked with nothing; a text of fewer words than a shingle is one
    shingle; very long texts are taken whole. Repeated rows share a component; a repeated id with different texts is judged
    row by row. A null id is linked with nothing and kept, with a null component. Other columns, whatever their names, are
    not looked at. An empty table gives no rows.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"lists and estimates find pairs from a similarity of {SIMILARITY} hundredths on")
    rows = written(sketches(docs, words=words, id_col=id_col, text_col=text_col), "sketches")
    named = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    first = named.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("x")).select("digest", "x.*")
    # a class goes by its least doc_id; of classes of one doc_id all but one go by a hash
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("digest"))
    name = F.when(nth == 1, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "digest"))
    classes = written(first.select("digest", name.alias("id"), "doc_id", "n", "sketch"), "classes")
    several = classes.filter("n > 1")
    groups = components(candidates(several.select("id", "sketch"))).join(several.select("id", "doc_id", "digest", "n"), "id")
    labels = components(verified(docs, groups, similarity=similarity, words=words, id_col=id_col, text_col=text_col))
    linked_classes = written(labels.join(classes.select("id", "doc_id", "digest"), "id"), "linked")
    least = linked_classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.select("digest", "doc_id").join(linked_classes.join(least, "component").select("digest", "component_id"), "digest", "left")
    of_class = of_class.select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    joined = rows.select("doc_id", "n", "text_sha256", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_sha256")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 85 hundredths."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), similarity=85).drop("text_sha256")
