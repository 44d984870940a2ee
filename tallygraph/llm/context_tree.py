"""Language-model scores by context-tree weighting over bytes.

A text is its bytes and an end. Each of these symbols is a chain of binary decisions (the end or not, then eight bits),
and each decision has a node in the tree of every context from none to DEPTH bytes. A node's Krichevsky-Trofimov estimate
is mixed with what its longer contexts give: with Pe the estimate's probability of the node's training bits,
Pw = (Pe + product of Pw of the longer contexts) / 2, and the estimate's share of a prediction is Pe / (2 Pw). A context
that training has not seen takes no part.

The tree has the same depth at every size of corpus, and lies in shards: strings whose contexts end in the same UPPER bytes
meet, so all nodes of contexts at least as long are whole in one shard, and the few of shorter contexts (with UPPER = 2 at
most 257 contexts) are added up from sums. Corpus counts (of strings and of words) are made where the texts are, packed by
shard and added up there, so that no word or string, however common, meets in one task. Texts look their most frequent
strings and words up in bounded tables; all others go, packed, to their shard as a stream, which answers with sums for each text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U64, buffers, mix, word_hashes
from .language_id import added, remainder
from .shared import bounded_batches, machine, pieces, record, width, written

#: Bytes of the longest context, and of the contexts that name a shard.
DEPTH, UPPER = 5, 2
#: Most frequent strings and words that every task holds; all others are looked up in shards.
COMMON_STRINGS, COMMON = 1 << 20, 1 << 17
#: Entries that a task gathers before it passes them on, and bytes of texts or entries handled at once.
GATHERED, PIECE = 1 << 20, 1 << 20
#: A symbol's bits in a string, the end of a text as a symbol, and the token after each text as a word's hash.
SYMBOL, STOP, END = 9, 256, U64(0x5EED0FE4D)
STRINGS, WORDS, OWN = 0, 1, 2
STATS = "kind int, shard int, keys binary, counts binary"


def up_to(depth: int) -> U64:
    """The part of a string that is its symbol and depth bytes of context."""
    return U64((1 << SYMBOL + 8 * depth) - 1)


def symbol_strings(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the texts (bytes, then the end) the depth bytes before it in its text (zeros before the beginning) and itself, as one number; and each text's first."""
    texts, lengths = len(at) - 1, np.diff(at)
    first = at + np.arange(texts + 1)
    symbols = np.full(len(data) + texts, STOP, U64)
    symbols[np.arange(len(data)) + np.repeat(np.arange(texts), lengths)] = data
    position, out = np.arange(len(symbols)) - np.repeat(first[:-1], lengths + 1), symbols.copy()
    for j in range(1, depth + 1):
        back = np.zeros(len(symbols), U64)
        back[j:] = symbols[: max(len(symbols) - j, 0)]
        back[position < j] = 0
        out |= back << U64(SYMBOL + 8 * (j - 1))
    return out, first


def shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """Words by their hash; strings by the last UPPER bytes of the context."""
    return ((keys if kind == WORDS else mix(keys >> U64(SYMBOL) & U64((1 << 8 * UPPER) - 1))) % U64(shards)).astype(np.int64)


def in_shards(kind: int, keys: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by shard, and for each shard that has keys its number and their range."""
    of = shard_of(kind, keys, shards)
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(shards + 1))
    return order, [(s, int(cut[s]), int(cut[s + 1])) for s in np.flatnonzero(np.diff(cut)).tolist()]


def corpus_counts(docs: DataFrame, shards: int, *, depth: int = DEPTH, text_col: str = "text") -> DataFrame:
    """kind, shard, keys, counts: one row for each kind and shard with all distinct keys of it in order and their counts in the texts."""
    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: (np.zeros(0, U64), np.zeros(0, np.int64)) for k in (STRINGS, WORDS)}

        def flush(kind: int) -> pa.RecordBatch:
            order, ranges = in_shards(kind, held[kind][0], shards)
            keys, counts = (x[order] for x in held[kind])
            held[kind] = np.zeros(0, U64), np.zeros(0, np.int64)
            return record(schema, [kind] * len(ranges), [s for s, _, _ in ranges], [keys[a:b].tobytes() for _, a, b in ranges], [counts[a:b].tobytes() for _, a, b in ranges])

        for batch in batches:
            data, at = buffers(batch.column(0))
            for a, b in pieces(np.diff(at).tolist(), PIECE):
                part, own = data[at[a] : at[b]], at[a : b + 1] - at[a]
                hashes, _ = word_hashes(part, own)
                new = {STRINGS: np.unique(symbol_strings(part, own, depth)[0], return_counts=True), WORDS: np.unique(np.append(hashes, np.repeat(END, b - a)), return_counts=True)}
                for kind, counted in new.items():
                    held[kind] = added(*held[kind], *counted)
                    if len(held[kind][0]) > GATHERED:
                        yield flush(kind)
        for kind in held:
            yield flush(kind)

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(0, U64), np.zeros(0, np.int64)
        for keys, counts in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total = added(*total, np.frombuffer(keys, U64), np.frombuffer(counts, np.int64))
        return pa.table([[key[0].as_py()], [key[1].as_py()], [total[0].tobytes()], [total[1].tobytes()]], schema=schema)

    bounded_batches(docs.sparkSession)
    return docs.select(text_col).mapInArrow(gather, STATS).groupBy("kind", "shard").applyInArrow(add_up, STATS)


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log(Gamma(n + 1/2)), by distinct values."""
    distinct, where = np.unique(n, return_inverse=True)
    return np.array([math.lgamma(x + 0.5) for x in distinct.tolist()])[where.ravel()]


def log_factorial(n: np.ndarray) -> np.ndarray:
    distinct, where = np.unique(n, return_inverse=True)
    return np.array([math.lgamma(x + 1.0) for x in distinct.tolist()])[where.ravel()]


@dataclass
class Level:
    """Nodes of one depth in order of key (context, then the symbol's bits so far after a leading 1): chance of a one, share of this estimate in the mixture."""

    keys: np.ndarray
    one: np.ndarray
    share: np.ndarray


def decisions(strings: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node keys in order with their counts of zeros and ones; strings come in order, so those of a node stand together."""
    context, symbol, parts = strings >> U64(SYMBOL) << U64(SYMBOL), strings & U64((1 << SYMBOL) - 1), []
    for bit in range(SYMBOL):
        if bit == 1:  # an end has no further bits
            going = symbol != STOP
            context, symbol, counts = context[going], symbol[going], counts[going]
        key = context | U64(1 << bit) | symbol >> U64(SYMBOL - bit)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        ones = np.add.reduceat(np.where(symbol >> U64(SYMBOL - 1 - bit) & U64(1), counts, 0), first) if len(first) else first
        parts.append((key[first], (np.add.reduceat(counts, first) if len(first) else first) - ones, ones))
    keys, zeros, ones = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    return keys[order], zeros[order], ones[order]


def shorter(nodes: np.ndarray, depth: int) -> np.ndarray:
    """The nodes for the same bits in the contexts of depth bytes."""
    return nodes & up_to(depth)


def weighted_levels(strings: np.ndarray, counts: np.ndarray, low: int, high: int, below: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[Level], tuple[np.ndarray, np.ndarray]]:
    """The levels from low to high of the strings' tree, and the lowest one's nodes with log Pw. Below are nodes of depth high and the sums of log Pw of their longer contexts, if any."""
    levels, order = [], np.argsort(strings)
    own, n = strings[order], counts[order]
    for d in range(high, low - 1, -1):
        own, n = added(own & up_to(d), n, own[:0], n[:0])
        keys, zeros, ones = decisions(own, n)
        estimate = log_gamma_half(zeros) + log_gamma_half(ones) - math.log(math.pi) - log_factorial(zeros + ones)
        weighted, share = estimate, np.ones(len(keys))
        if below is not None:
            product = np.bincount(np.searchsorted(keys, shorter(below[0], d)), weights=below[1], minlength=len(keys))
            weighted = np.logaddexp(estimate, product) - math.log(2)
            share = np.exp(estimate - weighted - math.log(2))
        levels.append(Level(keys, ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32), share.astype(np.float32)))
        below = keys, weighted
    return levels[::-1], below


def log10_probability(levels: list[Level], strings: np.ndarray) -> np.ndarray:
    """log10 probability of each string's symbol after its context, by all levels of the tree from the shortest context on."""
    context, symbol, total = strings >> U64(SYMBOL) << U64(SYMBOL), strings & U64((1 << SYMBOL) - 1), np.zeros(len(strings))
    for bit in range(SYMBOL):
        node, is_one = U64(1 << bit) | symbol >> U64(SYMBOL - bit), (symbol >> U64(SYMBOL - 1 - bit) & U64(1)).astype(bool)
        one, deeper = np.full(len(strings), 0.5), np.zeros(len(strings), bool)
        for d in range(len(levels) - 1, -1, -1):
            level, key = levels[d], context & up_to(d) | node
            if not len(level.keys):
                continue
            at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            seen, chance, share = level.keys[at] == key, level.one[at], level.share[at]
            one = np.where(seen, np.where(deeper, share * chance + (1 - share) * one, chance), one)
            deeper = seen
        going = np.ones(len(strings), bool) if bit == 0 else symbol != STOP
        total[going] += np.log10(np.where(is_one, one, 1 - one)[going])
    return total


def upper_levels(stats: DataFrame, depth: int) -> list[Level]:
    """The levels of contexts shorter than UPPER, from all shards' sums: their strings' counts and their nodes' sums of log Pw, 66,000 of each at most."""
    schema = pa.schema([("node", pa.bool_()), ("key", pa.int64()), ("count", pa.int64()), ("weighted", pa.float64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strings, counts in held_rows(batches):
            _, (nodes, weighted) = weighted_levels(strings, counts, UPPER, depth)
            keys, many = added(strings & up_to(UPPER - 1), counts, strings[:0], counts[:0])
            parents, where = np.unique(shorter(nodes, UPPER - 1), return_inverse=True)
            yield record(schema, np.zeros(len(keys), bool), keys.view(np.int64), many, np.zeros(len(keys)))
            yield record(schema, np.ones(len(parents), bool), parents.view(np.int64), np.zeros(len(parents), np.int64), np.bincount(where, weights=weighted))

    rows = stats.filter(F.col("kind") == STRINGS).select("keys", "counts").mapInArrow(sums, "node boolean, key long, count long, weighted double")
    got = rows.groupBy("node", "key").agg(F.sum("count").alias("count"), F.sum("weighted").alias("weighted")).toArrow()
    node, key, count, weighted = (got.column(c).to_numpy() for c in ("node", "key", "count", "weighted"))
    node = node.astype(bool)
    order = np.argsort(key[node])
    below = key[node][order].view(U64), weighted[node][order]
    return weighted_levels(key[~node].view(U64), count[~node], 0, UPPER - 1, below)[0]


def held_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of each row."""
    for batch in batches:
        for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
            yield np.frombuffer(keys.as_buffer(), U64), np.frombuffer(counts.as_buffer(), np.int64)


class Table:
    """Values of frequent strings: two hashed tables, and the few that find both places taken in order."""

    def __init__(self, strings: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(10, int(2 * max(len(strings), 1) - 1).bit_length())
        self.mask = U64(size - 1)
        self.seen = [np.full(size, U64(2**64 - 1)) for _ in range(2)]
        self.value = [np.zeros(size, np.float32) for _ in range(2)]
        left = np.arange(len(strings))
        for nth in range(2):
            at = self.place(strings[left], nth)
            self.seen[nth][at] = strings[left]  # the last of those that share a place stays
            held = self.seen[nth][at] == strings[left]
            self.value[nth][at[held]] = values[left[held]]
            left = left[~held]
        order = np.argsort(strings[left])
        self.others = strings[left][order], values[left][order]

    def place(self, strings: np.ndarray, nth: int) -> np.ndarray:
        h = strings * U64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[nth])
        return ((h >> U64(29)) & self.mask).astype(np.int64)

    def values(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the places of strings that are not held (with value 0)."""
        at = self.place(strings, 0)
        out = self.value[0][at]
        miss = np.flatnonzero(self.seen[0][at] != strings)
        if len(miss):
            at = self.place(strings[miss], 1)
            out[miss] = self.value[1][at]
            miss = miss[self.seen[1][at] != strings[miss]]
            out[miss] = 0
            value, found = looked_up(strings[miss], *self.others)
            out[miss] = value
            miss = miss[~found]
        return out, miss


@dataclass
class Base:
    """Unigram statistics: all training tokens, distinct ones, and the counts of common words in order of their hash."""

    tokens: int
    distinct: int
    keys: np.ndarray
    counts: np.ndarray

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def fitted(stats: DataFrame, shards: int, *, depth: int = DEPTH, common_strings: int = COMMON_STRINGS, common: int = COMMON) -> tuple[list[Level], tuple[np.ndarray, np.ndarray], Base]:
    """Upper levels, frequent strings with their log10 probabilities, and the base model. To the driver come bounded tables: the upper levels and about so many frequent strings and words."""
    upper = upper_levels(stats, depth)
    schema = pa.schema([("kind", pa.int32()), ("total", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
    top = {STRINGS: -(-common_strings // shards), WORDS: -(-common // shards)}

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, (keys, counts) in zip(batch.column(2).to_pylist(), held_rows(iter([batch])), strict=True):
                often = np.sort(np.argsort(-counts, kind="stable")[: top[kind]])
                if kind == STRINGS:
                    levels = [*upper, *weighted_levels(keys, counts, UPPER, depth)[0]]
                    values = np.concatenate([log10_probability(levels, keys[often[k : k + PIECE]]) for k in range(0, len(often), PIECE)] or [np.zeros(0)]).astype(np.float32)
                else:
                    values = counts[often]
                yield record(schema, [kind], [int(counts.sum())], [len(keys)], [keys[often].tobytes()], [values.tobytes()])

    got = stats.select("keys", "counts", "kind").mapInArrow(chosen, "kind int, total long, size long, keys binary, values binary").collect()
    of = {k: tuple(np.concatenate([np.frombuffer(r[c], t) for r in got if r["kind"] == k] or [np.zeros(0, t)]) for c, t in (("keys", U64), ("values", v))) for k, v in ((STRINGS, np.float32), (WORDS, np.int64))}
    order = np.argsort(of[WORDS][0])
    words = [r for r in got if r["kind"] == WORDS]
    return upper, of[STRINGS], Base(sum(r["total"] for r in words), sum(r["size"] for r in words), of[WORDS][0][order], of[WORDS][1][order])


def scored(docs: DataFrame, stats: DataFrame, upper: list[Level], common: tuple[np.ndarray, np.ndarray], base: Base, shards: int, *, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score for every row.

    A batch's own sums go, packed, to some shard; so do its strings and words that are not common, each to its shard of the
    corpus counts, where they pass as a stream and turn into sums for the batch's texts. Then every batch's rows are added up.
    """
    spark = docs.sparkSession
    shared, lookup, token = spark.sparkContext.broadcast((upper, base)), spark.sparkContext.broadcast(common), uuid.uuid4().hex
    types = [("kind", pa.int32()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
    sent = pa.schema([("shard", pa.int32()), *types])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unigrams = machine(("strings", token), lambda: Table(*lookup.value)), shared.value[1]
        end_count, _ = looked_up(np.array([END]), unigrams.keys, unigrams.counts)
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, (data, at) = batch.column(0), buffers(batch.column(1))
            for a, b in pieces(np.diff(at).tolist(), PIECE):
                name, n = task << 32 | nth, b - a
                nth += 1
                part, own = data[at[a] : at[b]], at[a : b + 1] - at[a]
                strings, begin = symbol_strings(part, own, depth)
                values, missing = table.values(strings)
                score_sum = np.concatenate([[0.0], np.cumsum(values.astype(np.float64))])
                hashes, first = word_hashes(part, own)
                owner = np.repeat(np.arange(n), np.diff(first))
                count, found = looked_up(hashes, unigrams.keys, unigrams.counts)
                known = np.bincount(owner[found], minlength=n) + int(end_count[0] > 0)
                sums = np.bincount(owner[found], weights=unigrams.log10(count[found]), minlength=n) + unigrams.log10(end_count)[0]
                numbers = np.stack([np.diff(first) + 1, known]).astype(np.int64)
                floats = np.stack([sums, np.diff(score_sum[begin])])
                named = ids[a:b].fill_null(0).to_numpy(), ids[a:b].is_valid().to_numpy(zero_copy_only=False)
                rows = [(name % shards, OWN, name, np.stack([named[0], named[1].astype(np.int64)]).tobytes(), numbers.tobytes(), floats.tobytes())]
                for kind, rare, theirs in ((STRINGS, strings[missing], np.searchsorted(begin, missing, side="right") - 1), (WORDS, hashes[~found], owner[~found])):
                    order, ranges = in_shards(kind, rare, shards)
                    rare, theirs = rare[order], theirs[order].astype(np.uint32)
                    rows += [(s, kind, name, rare[x:y].tobytes(), theirs[x:y].tobytes(), b"") for s, x, y in ranges]
                yield record(sent, *(list(c) for c in zip(*rows, strict=True)))

    back = "kind int, batch long, a binary, b binary, c binary"
    answer = pa.schema(types)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's counts come first of its kind, then what is asked."""
        above, unigrams = shared.value
        of, keys, counts, levels = None, np.zeros(0, U64), np.zeros(0, np.int64), above
        for batch in batches:
            shard, kind, held = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            edges = np.flatnonzero(np.diff(shard) | np.diff(kind) | np.diff(held.astype(np.int8))) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
                if lo == hi:
                    continue
                names, a, b, c = (batch.column(k).slice(lo, hi - lo) for k in range(3, 7))
                what = int(kind[lo])
                if of != (shard[lo], what):
                    of, keys, counts, levels = (shard[lo], what), np.zeros(0, U64), np.zeros(0, np.int64), above
                if held[lo]:
                    keys, counts = np.frombuffer(a[0].as_buffer(), U64).copy(), np.frombuffer(b[0].as_buffer(), np.int64).copy()
                    if what == STRINGS:
                        levels = [*above, *weighted_levels(keys, counts, UPPER, depth)[0]]
                    continue
                if what == OWN:
                    yield record(answer, [OWN] * (hi - lo), names, a, b, c)
                    continue
                asked, cut = np.frombuffer(buffers(a)[0].tobytes(), U64), buffers(a)[1] // 8
                owner = np.frombuffer(buffers(b)[0].tobytes(), np.uint32).astype(np.int64) + np.repeat(np.arange(hi - lo) << 32, np.diff(cut))
                if what == STRINGS:
                    distinct, where = np.unique(asked, return_inverse=True)
                    value, known = log10_probability(levels, distinct)[where], np.zeros(len(asked), bool)
                else:
                    count, known = looked_up(asked, keys, counts)
                    value = unigrams.log10(count)
                texts, where = np.unique(owner, return_inverse=True)
                value, known = np.bincount(where, weights=value, minlength=len(texts)), np.bincount(where[known], minlength=len(texts)).astype(np.int64)
                ends = np.searchsorted(texts >> 32, np.arange(hi - lo + 1)).tolist()
                ranges = list(zip(ends, ends[1:], strict=False))
                yield record(answer, [what] * (hi - lo), names, *([x[p:q].tobytes() for p, q in ranges] for x in (texts & 0xFFFFFFFF, known, value)))

    def add_up(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True), key=lambda r: r[:2])
        _, a, b, c = rows.pop()
        names, numbers, floats = np.frombuffer(a, np.int64).reshape(2, -1), np.frombuffer(b, np.int64).reshape(2, -1).copy(), np.frombuffer(c, np.float64).reshape(2, -1).copy()
        for kind, a, b, c in rows:
            texts = np.frombuffer(a, np.int64)
            if kind == WORDS:
                numbers[1, texts] += np.frombuffer(b, np.int64)
            floats[1 if kind == STRINGS else 0, texts] += np.frombuffer(c, np.float64)
        return pa.table([pa.array(names[0], pa.int64(), mask=names[1] == 0), numbers[0], numbers[1], floats[0], floats[1]], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    bounded_batches(spark)
    asked = docs.select(id_col, text_col).mapInArrow(score, "shard int, kind int, batch long, a binary, b binary, c binary")
    held = stats.select("shard", "kind", F.lit(True).alias("held"), F.lit(0).cast("long").alias("batch"), F.col("keys").alias("a"), F.col("counts").alias("b"), F.lit(b"").alias("c"))
    together = held.unionByName(asked.withColumn("held", F.lit(False))).repartition(shards, "shard").sortWithinPartitions("shard", "kind", F.desc("held"))
    answered = together.select("shard", "kind", "held", "batch", "a", "b", "c").mapInArrow(look_up, back)
    return answered.groupBy("batch").applyInArrow(add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def looked_up(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the asked keys (0 if absent) and whether they are there; keys are in order."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    found = keys[at] == asked
    return np.where(found, counts[at], 0), found


def lm_scores(docs: DataFrame, learnt: Column, *, depth: int = DEPTH, common_strings: int = COMMON_STRINGS, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: all rows scored by models of the rows for which learnt holds.

    A null or empty text is its end alone; very long texts are taken whole. Repeated rows are scored alike, ids may be null;
    other columns, whatever their names, are not looked at. With nothing to learn from, no token is known and each decision
    has probability 1/2. An empty table gives no rows.
    """
    shards = width(docs.sparkSession)
    stats = written(corpus_counts(docs.filter(learnt), shards, depth=depth, text_col=text_col), "corpus-counts")
    upper, frequent, base = fitted(stats, shards, depth=depth, common_strings=common_strings, common=common)
    out = scored(docs, stats, upper, frequent, base, shards, depth=depth, id_col=id_col, text_col=text_col)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(base.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those with crc32(doc_id) mod 10 = 0 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    scores = lm_scores(docs, remainder("doc_id", 10) != 0)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
