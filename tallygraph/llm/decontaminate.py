"""Benchmark decontamination: documents that hold a passage within a small edit distance of a benchmark item.

Texts are lower-cased words joined by single spaces. Windows lie at a fixed stride over each whole text and at every place of
each item; a CGK random walk embeds a window, so that few edits become few differing positions. Samples of the positions
are keys, repeated until a passage with as many edits as an item allows shares one with the target recall. Where a window
shares a key with an item, bounds from the item's parts and then its exact edit distance to the surroundings decide.

Windows have sizes to suit their items: SIZES has three, and items too small for any meet every place of every text.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernel import buffers
from .shared import bounded_batches, machine, pieces, record

#: Edits allowed for each character of the item.
EDITS = 0.2
#: Random walks of a size, and items of so few characters that a whole word must stand in the text if they allow no edit.
WALKS, WORD = 2, 5
#: Windows walked at once, places compared at once, characters of a cell of places, and characters of a part of an item.
LANES, COMPARED, CELL, PART = 1 << 13, 1 << 11, 64, 64
#: Bytes of items that one pass over the documents holds; their tables have some 150 times as many.
ITEM_BYTES = 1 << 20
GOLDEN = np.uint32(0x9E3779B1)

#: What a byte is in a normal text: letters and digits of ASCII in lower case, bytes of other characters, else a space.
NORMAL = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    NORMAL[_b] = _b
NORMAL[65:91] = range(97, 123)


@dataclass(frozen=True)
class Size:
    """Windows for items of at least so many characters: steps of a walk (two for a character, about), positions of a sample, samples of a walk, stride over the texts."""

    least: int
    steps: int
    sample: int
    repeats: int
    stride: int


#: Measured recall of passages within the limit: see the README and the tests.
SIZES = (Size(72, 40, 12, 4, 4), Size(40, 32, 8, 8, 2), Size(24, 28, 7, 8, 1))


def symbols_of(text: str) -> np.ndarray:
    """A byte for each character: itself in ASCII, a hash with the high bit set beyond it."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, codes, codes * GOLDEN >> np.uint32(25) | np.uint32(128)).astype(np.uint8)


def normalised(column: pa.Array) -> Iterator[tuple[int, str, np.ndarray]]:
    """For ranges of the texts in turn: the first one's index, their normal texts end to end, and each one's first character there (one more at the end). A normal text may end in a space."""
    data, at = buffers(pc.utf8_lower(column))
    for a, b in pieces(np.diff(at).tolist()):
        part, own = NORMAL[data[at[a] : at[b]]], at[a : b + 1] - at[a]
        space = part == 32
        after = np.empty(len(part), bool)
        after[:1], after[1:] = True, space[:-1]
        after[own[:-1][own[:-1] < len(part)]] = True
        keep = ~(space & after)
        part, ends = part[keep], own.tolist()
        begins = np.cumsum([0, *(np.count_nonzero(keep[x:y]) for x, y in zip(ends, ends[1:], strict=False))])
        if part.max(initial=0) >= 128:
            starts, ends = (part & 0xC0) != 0x80, begins.tolist()
            begins = np.cumsum([0, *(np.count_nonzero(starts[x:y]) for x, y in zip(ends, ends[1:], strict=False))])
        yield a, part.tobytes().decode("utf-8", "replace"), begins


def embedded(symbols: np.ndarray, begin: np.ndarray, masks: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """CGK walks from the places given, a row for each step: copy the symbol under a pointer, which moves on or stays as a random bit of the step and the symbol says."""
    out = np.empty((len(masks), len(begin)), np.uint8)
    for k in range(0, len(begin), LANES):
        at = begin[k : k + LANES].astype(np.int64)
        bit = np.empty(len(at), np.uint8)
        for row, mask, flip in zip(out[:, k : k + LANES], masks, flips, strict=True):
            symbols.take(at, out=row, mode="clip")
            np.bitwise_and(row, mask, out=bit)
            np.bitwise_count(bit, out=bit)
            bit += flip
            bit &= 1
            at += bit
    return out


def sampled(rows: np.ndarray, positions: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A key for each walk: a hash of the symbols at the sample's positions."""
    key = np.zeros(rows.shape[1], np.uint32)
    for p, w in zip(positions.tolist(), weights, strict=True):
        key += rows[p] * w
    return key * GOLDEN


def edit_distance(item: str, text: str, most: int) -> int:
    """Least edit distance of the item to any substring of the text, by bit-parallel dynamic programming; more than most is given as most + 1."""
    if item in text:
        return 0
    places: dict[str, int] = {}
    for k, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, now = full, 0, len(item)
    best = now
    for c in text:
        same = places.get(c, 0)
        flat = (((same & up) + up) ^ up) | same | down
        rises, falls = down | ~(flat | up) & full, up & flat
        now += bool(rises & top) - bool(falls & top)
        rises, falls = rises << 1 & full, falls << 1 & full
        up, down = falls | ~(same | down | rises) & full, rises & (same | down)
        best = min(best, now)
    return min(best, most + 1)


@dataclass
class Keys:
    """One sample's keys of the items in order, each once for an item, with the first and the last place it comes from; and which high bits occur."""

    key: np.ndarray
    item: np.ndarray
    first: np.ndarray
    last: np.ndarray
    occurs: np.ndarray
    shift: np.uint32

    @classmethod
    def of(cls, key: np.ndarray, item: np.ndarray, place: np.ndarray) -> Keys:
        order = np.lexsort((place, item, key))
        key, item, place = key[order], item[order], place[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
        at = np.flatnonzero(new)
        bits = min(max(16, (16 * len(key)).bit_length()), 24)
        occurs, shift = np.zeros(1 << bits, bool), np.uint32(32 - bits)
        occurs[key >> shift] = True
        return cls(key[at], item[at].astype(np.int32), place[at].astype(np.int32), place[np.append(at[1:], len(key)) - 1].astype(np.int32), occurs, shift)

    def shared(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of asked keys and entries that are equal."""
        asked = np.flatnonzero(self.occurs.take(key >> self.shift))
        a = np.searchsorted(self.key, key[asked])
        many = np.searchsorted(self.key, key[asked], side="right") - a
        return np.repeat(asked, many), np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Items:
    """The benchmark's side: normal texts, their embedded windows' keys and their parts."""

    def __init__(self, ids: list[int], texts: list[str | None], edits: float = EDITS) -> None:
        self.ids, self.texts = [], []
        for a, joined, begins in normalised(pa.array(texts, pa.string())):
            for k, (b, e) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                if ids[a + k] is not None and joined[b:e].strip():
                    self.ids.append(ids[a + k])
                    self.texts.append(joined[b:e].strip())
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.floor(edits * self.sizes + 1e-9).astype(np.int64)
        self.small = np.flatnonzero(self.sizes < min(s.least for s in SIZES))
        self.symbols = [symbols_of(t) for t in self.texts]
        self.tables = []
        for nth, size in enumerate(SIZES):
            upper = SIZES[nth - 1].least if nth else self.sizes.max(initial=0) + 1
            own = np.flatnonzero((self.sizes >= size.least) & (self.sizes < upper))
            if len(own):
                self.tables.append((size, [self.walk(size, nth * WALKS + w, own) for w in range(WALKS)]))
        self.cut()

    def walk(self, size: Size, seed: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[Keys]]:
        """Bits of one walk, its samples' positions and weights, and the keys of all windows of these items that a walk does not leave too soon."""
        rng = np.random.default_rng(seed)
        masks, flips = rng.integers(0, 256, size.steps).astype(np.uint8), rng.integers(0, 2, size.steps).astype(np.uint8)
        positions = np.array([np.sort(rng.choice(size.steps, size.sample, replace=False)) for _ in range(size.repeats)])
        weights = rng.integers(0, 1 << 31, size.sample).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        gap = np.zeros(size.steps, np.uint8)
        joined = np.concatenate([x for k in own.tolist() for x in (self.symbols[k], gap)])
        before = np.cumsum(self.sizes[own] + size.steps) - self.sizes[own] - size.steps
        many = self.sizes[own] - size.steps // 2 + 1
        item, place = np.repeat(own, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        rows = embedded(joined, np.repeat(before, many) + place, masks, flips)
        return masks, flips, positions, weights, [Keys.of(sampled(rows, p, weights), item, place) for p in positions]

    def cut(self) -> None:
        """Parts of at most PART characters of all items: the first one's number by item, ends, and a bit for each place of each of 32 classes of symbols."""
        many = -(-self.sizes // PART)
        self.first = np.concatenate([[0], np.cumsum(many)])
        ends = [(k * n // m, (k + 1) * n // m) for n, m in zip(self.sizes.tolist(), many.tolist(), strict=True) for k in range(m)]
        self.parts = np.array(ends, np.int64).reshape(-1, 2)
        owner = np.repeat(np.arange(len(many)), many).tolist()
        self.equal = np.zeros((len(ends), 32), np.uint64)
        for p, (k, (a, b)) in enumerate(zip(owner, ends, strict=True)):
            np.bitwise_or.at(self.equal[p], self.symbols[k][a:b] & 31, np.uint64(1) << np.arange(b - a, dtype=np.uint64))

    def cells(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Rows text, item, cell, each once: where in the texts an item may begin, less or more its edits."""
        found, lengths, wide = [], np.diff(begins), int(np.diff(begins).max(initial=0)) // CELL + 64
        low = int(self.sizes.max(initial=0)) // CELL + 2  # cells before a text's beginning
        name = lambda text, item, cell: (text * len(self.ids) + item) * (wide + low) + cell + low
        for size, walks in self.tables:
            window = np.arange(0, max(int(begins[-1]) - size.steps // 4, 0), size.stride)
            text = np.searchsorted(begins, window, side="right") - 1
            place = window - begins[text]
            for masks, flips, positions, weights, keys in walks:
                rows = embedded(symbols, window, masks, flips)
                for p, k in zip(positions, keys, strict=True):
                    asked, entry = k.shared(sampled(rows, p, weights))
                    last = (place[asked] - k.first[entry]) // CELL
                    first = (place[asked] - k.last[entry]) // CELL
                    many = last - first + 1
                    cell = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    found.append(np.unique(name(np.repeat(text[asked], many), np.repeat(k.item[entry], many), cell)))
        if len(self.small):
            many = -(-lengths // CELL)
            text = np.repeat(np.arange(len(lengths)), many)
            cell = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found += [name(text, k, cell) for k in self.small.tolist()]
        names = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cell, names = names % (wide + low) - low, names // (wide + low)
        return np.stack([names // max(len(self.ids), 1), names % max(len(self.ids), 1), cell], 1)

    def bounded(self, symbols: np.ndarray, begins: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The cells in which the item's parts, each at its best place, have no more edits in all than the item may have: no passage is lost."""
        classes = (np.concatenate([symbols, np.zeros(1, np.uint8)]) & 31).astype(np.int64)
        cells = cells[np.argsort(self.most[cells[:, 1]], kind="stable")]
        edits, left, nth = np.zeros(len(cells), np.int64), np.arange(len(cells)), 0
        while len(left):
            for k in range(0, len(left), COMPARED):
                rows = left[k : k + COMPARED]
                text, item, cell = cells[rows].T
                part, most = self.first[item] + nth, self.most[item]
                begin = begins[text] + cell * CELL - most + self.parts[part, 0]
                edits[rows] += self.least(classes, begin, part, int((2 * most + self.parts[part, 1] - self.parts[part, 0]).max()) + CELL)
            nth += 1
            left = left[(edits[left] <= self.most[cells[left, 1]]) & (nth < np.diff(self.first)[cells[left, 1]])]
        return cells[edits <= self.most[cells[:, 1]]]

    def least(self, classes: np.ndarray, begin: np.ndarray, part: np.ndarray, reach: int) -> np.ndarray:
        """Edit distances of parts to any part of the next reach characters, or less: symbols are told apart by classes; bit-parallel dynamic programming, for all at once."""
        size, one = (self.parts[part, 1] - self.parts[part, 0]).astype(np.uint64), np.uint64(1)
        equal, base, top, now = self.equal.ravel(), part * 32, size - one, size.astype(np.int64)
        best, up, down = now.copy(), np.full(len(part), 2**64 - 1, np.uint64), np.zeros(len(part), np.uint64)
        for j in range(reach):
            same = equal.take(base + classes.take(begin + j, mode="clip"))
            flat = (((same & up) + up) ^ up) | same
            rises, falls = down | ~(flat | up), up & flat
            same |= down
            now += (rises >> top & one).view(np.int64)
            now -= (falls >> top & one).view(np.int64)
            rises <<= one
            falls <<= one
            up, down = falls | ~(same | rises), rises & same
            np.minimum(best, now, out=best)
        return best

    def found(self, column: pa.Array) -> dict[tuple[int, int], int]:
        """Least edits by text and item, for all pairs within the item's edits."""
        out: dict[tuple[int, int], int] = {}
        for first, joined, begins in normalised(column):
            symbols = symbols_of(joined)
            cells = self.bounded(symbols, begins, self.cells(symbols, begins))
            cells = cells[np.lexsort(cells.T[::-1])]
            new = np.ones(len(cells), bool)
            new[1:] = (cells[1:, :2] != cells[:-1, :2]).any(1) | (cells[1:, 2] > cells[:-1, 2] + 1)
            at = np.flatnonzero(new)
            for (text, item, low), high in zip(cells[at].tolist(), cells[np.append(at[1:], len(cells)) - 1, 2].tolist() if len(at) else [], strict=True):
                whole, most, name = joined[begins[text] : begins[text + 1]].strip(), int(self.most[item]), self.texts[item]
                if most == 0 and len(name) <= WORD and name.isascii():  # a short word within another is none
                    edits = 0 if f" {name} " in f" {whole} " else 1
                else:
                    edits = edit_distance(name, whole[max(low * CELL - most, 0) : max((high + 1) * CELL + len(name) + most, 0)], most)
                if edits <= most:
                    out[first + text, item] = min(edits, out.get((first + text, item), edits))
        return out


def matches(docs: DataFrame, ids: list[int], texts: list[str | None], edits: float = EDITS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits: for each text and item the least distance of a passage, if it is small enough. The id may be of any type, as a digest of the text."""
    kind = docs.schema[id_col].dataType
    shared, token = docs.sparkSession.sparkContext.broadcast((ids, texts)), uuid.uuid4().hex
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("item_id", pa.int64()), ("edits", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = machine(("items", token), lambda: Items(*shared.value, edits))
        for batch in batches:
            found, names = items.found(batch.column(1)), batch.column(0).to_pylist()
            yield record(schema, [names[t] for t, _ in found], [items.ids[n] for _, n in found], list(found.values()))

    bounded_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(find, f"doc_id {kind.simpleString()}, item_id long, edits int")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row doc_id, item_id, edits (the least found) for each document and item whose passage it holds.

    The items are broadcast in blocks of ITEM_BYTES, one pass over the documents for each. Null and empty texts and
    items without a word match nothing, as do items with a null id; repeated documents give one row; documents with a
    null id share one. Other columns, whatever their names, are not looked at. Without documents or items there are no rows.
    """
    size = F.coalesce(F.octet_length(item_text), F.lit(0)) + 64
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).collect()[0]["n"]
    blocks, found = max(1, -(-total // ITEM_BYTES)), None
    for k in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == k).select(item_id, item_text).collect()
        part = matches(docs, [r[0] for r in rows], [r[1] for r in rows], edits, id_col=id_col, text_col=text_col)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
