"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Best fit decreasing only asks how many pieces there are of each length, so it is planned on that histogram: a segment
tree over remaining capacities finds the tightest open bin for a length in logarithmic time, and equal pieces are placed
in runs. The plan has a size bounded by the capacity alone. Every piece then takes its place by its rank among the
pieces of its length, which is computed in shards, so no length, however common, meets in one task.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernel import U64, buffers, run_hashes, words
from .shared import bounded_batches, machine, pieces, record, written

CAPACITY = 2048
#: Pieces of one length that one task ranks.
RANKED = 50_000
#: Unicode's White_Space, as a fixed list: the standard module's \\s also takes the separators 1C to 1F.
WHITE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The one pattern of pre-tokens that this encoder knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class SegmentTree:
    """Numbers of open bins by remaining capacity, with the smallest occupied capacity of at least a given size."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        node = capacity + self.leaves
        while node:
            self.held[node] += bins
            node >>= 1

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        if self.held[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.held[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.held[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Best fit decreasing for so many pieces of each length: runs (first rank, pieces for each bin, first bin, offset) by length, and the number of bins.

    The piece of rank k of a run from rank f with m pieces for each bin goes to bin first + (k - f) // m, at offset + (k - f) % m * length.
    """
    tree, groups, runs, bins = SegmentTree(capacity), defaultdict(list), defaultdict(list), 0

    def fill(length: int, rank: int, free: int, first: int, many: int, each: int) -> None:
        runs[length].append((rank, each, first, capacity - free))
        left = free - each * length
        if left:
            groups[left].append((first, many))
            tree.add(left, many)

    for length in sorted(histogram, reverse=True):
        rank, waiting = 0, histogram[length]
        while waiting:
            free = tree.tightest(length)
            if free is None:
                free, first, many = capacity, bins, -(-waiting // (capacity // length))
                bins += many
            else:
                first, many = groups[free].pop()
                tree.add(free, -many)
            each = free // length
            whole = min(many, waiting // each)
            if whole:
                fill(length, rank, free, first, whole, each)
                rank, waiting = rank + whole * each, waiting - whole * each
            if waiting and whole < many:
                fill(length, rank, free, first + whole, 1, waiting)
                rank, waiting, whole = rank + waiting, 0, whole + 1
            if whole < many:
                groups[free].append((first + whole, many - whole))
                tree.add(free, many - whole)
    return dict(runs), bins


class Recent(dict):
    """A dictionary of about kept recent entries and as many before them."""

    def __init__(self, kept: int) -> None:
        super().__init__()
        self.kept, self.older = kept, {}

    def __missing__(self, key: str) -> bytes | None:
        return self.older.get(key)

    def learn(self, fresh: dict[str, bytes]) -> None:
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        self.update((k, v) for k, v in fresh.items() if len(k) <= 64)


class RunTable:
    """Ids of known runs by the run's 64-bit hash: an open table of places and the ids end to end."""

    PLACES = 1 << 22

    def __init__(self, runs: int = 0) -> None:
        """With room for so many runs at least."""
        self.places = max(self.PLACES, 1 << (4 * runs).bit_length())
        self.keys, self.entry = np.zeros(self.places, U64), np.full(self.places, -1, np.int32)
        self.ids, self.at, self.filled = np.zeros(1 << 20, "<u4"), np.zeros(self.places // 2 + 1, np.int64), 0

    def room(self, runs: int) -> bool:
        return self.filled + runs <= self.places // 2

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries, -1 for unknown ones."""
        out, todo = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        place = (hashes & U64(self.places - 1)).astype(np.int64)
        while len(todo):
            entry = self.entry[place]
            same = self.keys[place] == hashes[todo]
            out[todo[same]] = entry[same]
            go = ~same & (entry >= 0)
            todo, place = todo[go], (place[go] + 1) & (self.places - 1)
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """New and distinct hashes; at most half of the places are filled."""
        first, last = self.filled, self.filled + len(ids)
        self.at[first + 1 : last + 1] = self.at[first] + np.cumsum([len(x) // 4 for x in ids])
        while self.at[last] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.at[first] : self.at[last]] = np.frombuffer(b"".join(ids), "<u4")
        self.filled, entries = last, np.arange(first, last, dtype=np.int32)
        place = (hashes & U64(self.places - 1)).astype(np.int64)
        while len(entries):
            free = np.flatnonzero(self.entry[place] < 0)
            self.entry[place[free]] = entries[free]  # of those that want one place the last gets it
            self.keys[place[free]] = hashes[free]
            go = self.entry[place] != entries
            entries, hashes, place = entries[go], hashes[go], (place[go] + 1) & (self.places - 1)

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' ids end to end, and their numbers."""
        start, many = self.at[entries], self.at[entries + 1] - self.at[entries]
        return self.ids[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())], many


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The file's pattern matches no white space, so a text's ids are those of its runs of other characters, end to end, and
    a run's ids are those of its matches. Runs are looked up all at once; the library encodes the new matches of many
    texts in one call, in which the tokens that end a word show where each match ends.
    """

    KEPT_WORDS = 250_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", ())]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", ())
        pattern = splits[0].get("pattern", {}).get("Regex") if splits else None
        suffix = spec["model"].get("end_of_word_suffix")
        if kinds != ["NFC", "Replace", "Lowercase"] or pattern != PATTERN or not suffix or spec["post_processor"]:
            raise ValueError(f"{path}: not a lower-casing word-level BPE file")
        self.library = Tokenizer.from_file(path)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        ranges = lambda p: "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(f"{p}+", every))
        letters, numbers = ranges(r"\p{L}"), ranges(r"\p{N}")
        self.matches = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+").findall
        self.marked = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)").search
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[k for t, k in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.known, self.words = RunTable(), Recent(self.KEPT_WORDS)
        self.key = int.from_bytes(os.urandom(8), "little")  # runs are known by their hash, within this process only

    def encode(self, texts: pa.Array) -> list[bytes]:
        """A run here ends at white space of ASCII; other white space within it only parts its matches."""
        data, at = buffers(texts)
        starts, ends, first = words(data, at)
        hashes = run_hashes(data, starts, ends, self.key)
        entries = self.known.find(hashes)
        new = np.flatnonzero(entries < 0)
        if len(new):
            fresh, sample = np.unique(hashes[new], return_index=True)
            raw, sample = data.tobytes(), new[sample]
            runs = [raw[a:b].decode() for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)]
            if not self.known.room(len(runs)):
                self.known = RunTable(len(np.unique(hashes)))  # full: this piece's runs are the first of a new one
                return self.encode(texts)
            self.known.add(fresh, self.of_runs(runs))
            entries[new] = self.known.find(hashes[new])
        ids, many = self.known.gather(entries)
        cut = (4 * np.concatenate([[0], np.cumsum(many)])[first]).tolist()
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def of_runs(self, runs: list[str]) -> list[bytes]:
        split = []
        for run in runs:
            if run.isascii() and run.isalpha():
                split.append((run.lower(),))
            elif self.marked(run):
                split.append(None)
            else:  # each character is lower-cased by itself: no final sigma
                split.append(self.matches((run if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ")).lower()))
        get = self.words.get
        known = {w: get(w) for own in split if own for w in own}
        learnt = self.of_words({w for w, ids in known.items() if ids is None})
        known |= learnt
        self.words.learn(learnt)
        return [
            np.asarray(self.library.encode(run, add_special_tokens=False).ids, "<u4").tobytes() if own is None else known[own[0]] if len(own) == 1 else b"".join([known[w] for w in own])
            for run, own in zip(runs, split, strict=True)
        ]

    def of_words(self, words: set[str]) -> dict[str, bytes]:
        out = {w: ids for w in words if (ids := self.words.older.get(w)) is not None}
        fresh = [w for w in words if w not in out]
        if fresh:
            ids = np.asarray(self.library.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(fresh):
                raise ValueError("the library splits words otherwise than this pattern")
            raw = ids.tobytes()
            out |= {w: raw[4 * a : 4 * b] for w, a, b in zip(fresh, [0, *stops], stops, strict=False)}
        return out


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return machine(("encoder", path), lambda: Encoder(path))


def tokenised_pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the closing id 0, cut every capacity tokens; and salt, the piece's number in its task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, done = encoder(path).encode, 0
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            strings = batch.column(1)
            encoded = (ids for a, b in pieces(np.diff(buffers(strings)[1]).tolist()) for ids in encode(strings[a:b]))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield record(schema, *rows, np.arange(done, done + len(rows[0])))
            done += len(rows[0])

    bounded_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def packed(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """The stored pieces with sequence_id and offset. Only the histogram of lengths, at most capacity rows, comes to the driver."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    shards = max(1, -(-max(histogram.values(), default=1) // RANKED))
    lengths = sorted(runs)
    first_run = np.cumsum([0, *(len(runs[n]) for n in lengths)])
    table = np.array([x for n in lengths for x in runs[n]], np.int64).reshape(-1, 4)
    where = {n: k for k, n in enumerate(lengths)}
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(shards)))
    before = W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    skipped = dealt.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")).select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    nth = F.row_number().over(W.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32", "salt"))
    ranked = dealt.withColumn("nth", nth).join(skipped, ["length", "shard"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("skipped") + F.col("nth") - 1).alias("rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                own = table[first_run[where[n]] : first_run[where[n] + 1]]
                run = own[np.searchsorted(own[:, 0], rank[rows], side="right") - 1]
                past = rank[rows] - run[:, 0]
                sequence[rows], offset[rows] = run[:, 2] + past // run[:, 1], run[:, 3] + past % run[:, 1] * n
            yield record(schema, *(batch.column(k) for k in range(5)), sequence, offset)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece with its place.

    A null or empty text is the one closing id, a very long one is cut; ids may be null; equal and repeated rows are packed
    one by one, dealt over all shards of their length; other columns, whatever their names, are not looked at; no rows give no rows.
    """
    return packed(written(tokenised_pieces(docs, path, capacity=capacity, id_col=id_col, text_col=text_col), "pieces"), capacity=capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by word_bpe_49k.json into sequences of 2048."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
