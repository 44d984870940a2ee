"""Removal of substrings that stand in an earlier document, by suffix arrays of content-dealt shards.

Every WIDTH-byte window has an anchor, the least K-byte string in it by hash, so equal windows have equal anchors.
Windows whose anchor stands in one document only are unique. The others' texts, each with the windows that share its
anchor's place, go to the anchor's shard, where equal windows thus meet: a suffix array of the shard's distinct texts,
sorted by induction, puts them side by side, common prefixes of neighbours tell which are equal, and the least document
of each run decides.

Documents are dealt into buckets of bounded size by a hash of the id. Between the passes go packed arrays for each bucket
and shard: anchors without their documents, each once for a bucket; texts once for each bucket, of its least document.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U64, buffers, mix, powers, prefix_sums, run_hashes
from .shared import bounded_batches, machine, pieces, text_or_empty, width
from .suffix_array import permuted_common_prefixes, suffix_array

WIDTH = 50
K = 24
#: Text bytes of a bucket of documents, and input bytes for each shard of anchors.
BUCKET_BYTES, SHARD_BYTES = 3 << 20, 4 << 20
SALT = 32
#: Stands for a null id: after all others.
LAST = 2**63 - 1
COPY, REPEATED, REMOVED, TEXTS = range(4)
PACKED = pa.schema([("at", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
PACKED_SQL = "at int, kind int, bucket int, a binary, b binary, c binary"


@dataclass
class Places:
    """Maximal runs of windows with one anchor: text, first and last start in the text, the anchor's hash and that of the bytes covered."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    covered: np.ndarray


def anchored(data: np.ndarray, at: np.ndarray) -> Places:
    """All windows of the texts by their anchors."""
    none = Places(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64)))
    long = np.flatnonzero(np.diff(at) >= WIDTH)
    if not len(long):
        return none
    sums, (_, down) = prefix_sums(data), powers(len(data) + 1)
    hashes = mix((sums[K:] - sums[:-K]) * down[: len(data) - K + 1])
    least = hashes & U64(0xFFFFFFFF00000000)
    least |= np.arange(len(hashes), dtype=U64)
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])  # of 2, 4, 8 and 16 places
    span = WIDTH - K + 1
    place = np.minimum(least[: len(data) - WIDTH + 1], least[span - 16 :]).astype(np.uint32)
    begins, ends = at[long], at[long + 1] - WIDTH  # the first and the last window of each text
    new, inside = np.empty(len(place) + 1, bool), np.zeros(len(place) + 1, np.int8)
    new[0], new[-1] = True, False
    np.not_equal(place[1:], place[:-1], out=new[1:-1])
    new[begins] = True
    inside[begins] += 1
    inside[ends + 1] -= 1
    new &= np.cumsum(inside, dtype=np.int8).view(bool)
    first = np.flatnonzero(new)
    nth = np.searchsorted(begins, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(data)) - 1, ends[nth])
    owner = long[nth]
    return Places(owner, first - at[owner], last - at[owner], hashes[place[first]], run_hashes(data, first, last + WIDTH))


def all_places(data: np.ndarray, at: np.ndarray) -> Places:
    """The same in pieces of bounded size."""
    parts = []
    for a, b in pieces(np.diff(at).tolist(), 1 << 20):
        part = anchored(data[at[a] : at[b]], at[a : b + 1] - at[a])
        part.text += a
        parts.append(part)
    return Places(*(np.concatenate([getattr(p, f) for p in parts] or [np.zeros(0, np.int64)]) for f in ("text", "first", "last", "anchor", "covered")))


@dataclass
class Bucket:
    """The documents of a bucket in an order of their own: ids, bytes, and which are copies of an earlier document's whole text."""

    ids: np.ndarray
    data: np.ndarray
    at: np.ndarray
    copy: np.ndarray

    @classmethod
    def of(cls, docs: pa.Table, messages: pa.Table) -> Bucket:
        order = docs.select(["id", "digest"]).append_column("nth", pa.array(np.arange(docs.num_rows))).sort_by([("id", "ascending"), ("digest", "ascending")]).column("nth")
        docs = docs.take(order).combine_chunks()
        data, at = buffers(docs.column("text").chunk(0)) if docs.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        copies = {(int(a), b) for kind, a, b in zip(*(messages.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True) if kind == COPY}
        rows = zip(docs.column("id").to_pylist(), (d.encode() for d in docs.column("digest").to_pylist()), strict=True)
        return cls(docs.column("id").to_numpy(), data, at, np.array([r in copies for r in rows], bool))

    def places(self) -> Places:
        """Of documents other than copies: a copy's windows all stand in the earlier document too."""
        found = all_places(self.data, self.at)
        keep = ~self.copy[found.text]
        return Places(*(getattr(found, f)[keep] for f in ("text", "first", "last", "anchor", "covered")))


def packed(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(list(zip(*rows, strict=True)) or [[]] * 6, PACKED, strict=True)], schema=PACKED)


def shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (mix(anchor) % U64(shards)).astype(np.int64)


def in_shards(of: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by shard, and for each shard that has entries its number and their range."""
    order = np.argsort(of, kind="stable")
    cut = np.searchsorted(of[order], np.arange(shards + 1))
    return order, [(s, int(cut[s]), int(cut[s + 1])) for s in np.flatnonzero(np.diff(cut)).tolist()]


def low(anchor: np.ndarray) -> np.ndarray:
    """With the shard's number, what names an anchor between passes; a chance meeting only costs a comparison."""
    return (anchor & U64(0xFFFFFFFF)).astype(np.uint32)


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    A byte goes if some WIDTH bytes that cover it also start in a document with a smaller id, whatever is removed there.
    A null text is empty; texts shorter than WIDTH lose nothing. Rows of the same id are the same document: they remove
    nothing from each other. A null id counts as larger than all others, as does the largest 64-bit number, which is taken
    for one and comes back null. Other columns, whatever their names, are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("id"), text_or_empty(text_col).alias("text"))
    total = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    buckets, shards = (max(width(spark), -(-total // size)) for size in (BUCKET_BYTES, SHARD_BYTES))
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")
    held = named.select(bucket, "id", F.sha2("text", 256).alias("digest"), "text")
    small = named.filter(F.octet_length("text") >= WIDTH).select("id", F.sha2("text", 256).alias("digest"))
    # only texts that repeat are joined back, and the rows of one are dealt over SALT tasks
    first = small.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    copies = small.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT))).join(first, ["digest", "salt"]).filter("id > least").select(F.lit(0).alias("at"), F.lit(COPY).alias("kind"), bucket, F.col("id").cast("string").cast("binary").alias("a"), F.col("digest").cast("binary").alias("b"), F.lit(b"").alias("c"))

    def anchors(held_rows: pa.Table, messages: pa.Table) -> pa.Table:
        machine(("anchors",))
        if not held_rows.num_rows:
            return packed([])
        found = np.unique(Bucket.of(held_rows, messages).places().anchor)
        order, ranges = in_shards(shard_of(found, shards), shards)
        names, number = low(found[order]), held_rows.column("bucket")[0].as_py()
        return packed([(s, REPEATED, number, np.unique(names[a:b]).tobytes(), b"", b"") for s, a, b in ranges])

    def repeated(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("at").to_pylist(), table.column("bucket").to_pylist(), table.column("a").to_pylist(), strict=True))
        names = [np.frombuffer(a, np.uint32) for _, _, a in rows]
        every = np.sort(np.concatenate(names))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for (shard, number, _), own in zip(rows, names, strict=True):
            both = own[member(own, again)]
            if len(both):
                out.append((shard, REPEATED, number, both.tobytes(), b"", b""))
        return packed(out)

    def texts(held_rows: pa.Table, messages: pa.Table) -> pa.Table:
        if not held_rows.num_rows:
            return packed([])
        number, own = held_rows.column("bucket")[0].as_py(), Bucket.of(held_rows, messages)
        found = own.places()
        shard, ids = shard_of(found.anchor, shards), own.ids[found.text]
        # anchors of other buckets' documents, and those of two documents of this one
        elsewhere = [U64(s) << U64(32) | np.frombuffer(a, np.uint32).astype(U64) for s, k, a in zip(*(messages.column(c).to_pylist() for c in ("at", "kind", "a")), strict=True) if k == REPEATED]
        name = shard.astype(U64) << U64(32) | low(found.anchor).astype(U64)
        _, where = np.unique(found.anchor, return_inverse=True)
        least, most = np.full(where.max(initial=-1) + 1, LAST), np.full(where.max(initial=-1) + 1, -(2**63))
        np.minimum.at(least, where, ids)
        np.maximum.at(most, where, ids)
        take = np.flatnonzero((least < most)[where] | (member(name, np.sort(np.concatenate(elsewhere))) if elsewhere else False))
        # equal texts: all but the least document's are removed as a whole
        order = np.lexsort((ids[take], found.covered[take], found.anchor[take]))
        take = take[order]
        new = np.ones(len(take), bool)
        new[1:] = (found.covered[take[1:]] != found.covered[take[:-1]]) | (found.anchor[take[1:]] != found.anchor[take[:-1]])
        lowest = ids[take][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(take) else ids[take]
        beaten = ids[take] > lowest
        gone, sent = take[beaten], take[~beaten]
        rows = []
        if len(gone):
            rows.append((number % shards, REMOVED, number, *spans_packed(found.text[gone], found.first[gone], found.last[gone] + WIDTH)))
        order, ranges = in_shards(shard[sent], shards)
        sent = sent[order]
        for s, a, b in ranges:
            part = sent[a:b]
            text, start, length = found.text[part], found.first[part], found.last[part] - found.first[part] + WIDTH
            rows.append((s, TEXTS, number, np.stack([own.ids[text], text, start, length]).astype(np.int64).tobytes(), gathered(own.data, own.at[text] + start, length).tobytes(), low(found.anchor[part]).tobytes()))
        return packed(rows)

    def sorted_shard(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "a", "b", "c")), strict=True))
        out = [(number, kind, number, a, b, c) for kind, number, a, b, c in rows if kind == REMOVED]
        own = [r for r in rows if r[0] == TEXTS]
        if own:
            heads = [np.frombuffer(a, np.int64).reshape(4, -1) for _, _, a, _, _ in own]
            ids, text, start, length = np.concatenate(heads, 1)
            number = np.repeat([r[1] for r in own], [h.shape[1] for h in heads])
            entry, begin, end = earlier(np.frombuffer(b"".join(r[3] for r in own), np.uint8), length, ids, np.concatenate([np.frombuffer(r[4], np.uint32) for r in own]))
            for name in np.unique(number[entry]).tolist():
                mine = number[entry] == name
                e = entry[mine]
                out.append((name, REMOVED, name, *spans_packed(text[e], start[e] + begin[mine], start[e] + end[mine])))
        return packed(out)

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(held_rows: pa.Table, messages: pa.Table) -> pa.Table:
        if not held_rows.num_rows:
            return result.empty_table()
        own = Bucket.of(held_rows, messages)
        parts = [tuple(np.frombuffer(x, np.uint32).astype(np.int64) for x in (a, b, c)) for kind, a, b, c in zip(*(messages.column(c).to_pylist() for c in ("kind", "a", "b", "c")), strict=True) if kind == REMOVED]
        text, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        change = np.zeros(len(own.data) + 1, np.int32)
        np.add.at(change, own.at[text] + begin, 1)
        np.add.at(change, own.at[text] + end, -1)
        gone = np.cumsum(change[:-1]) > 0
        rows = []
        for k, (a, b) in enumerate(zip(own.at[:-1].tolist(), own.at[1:].tolist(), strict=True)):
            lost = np.ones(b - a, bool) if own.copy[k] else gone[a:b]
            starts = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum())
            name = int(own.ids[k])
            rows.append((None if name == LAST else name, b - a, int(lost.sum()), starts, hashlib.sha256(own.data[a:b][~lost]).hexdigest()))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), result, strict=True)], schema=result)

    bounded_batches(spark)
    by_bucket = held.groupBy("bucket")
    found = by_bucket.cogroup(copies.groupBy("bucket")).applyInArrow(anchors, PACKED_SQL)
    again = found.groupBy("at").applyInArrow(repeated, PACKED_SQL)
    sent = by_bucket.cogroup(copies.unionByName(again).groupBy("bucket")).applyInArrow(texts, PACKED_SQL)
    judged = sent.groupBy("at").applyInArrow(sorted_shard, PACKED_SQL)
    return by_bucket.cogroup(copies.unionByName(judged).groupBy("bucket")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def member(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of the asked numbers are among the held ones, which are in order."""
    return held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked if len(held) else np.zeros(len(asked), bool)


def spans_packed(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Spans as arrays of text, begin and end; those of a text that meet are one."""
    order = np.lexsort((begin, text))
    text, begin, end = text[order], begin[order], end[order]
    reach = np.maximum.accumulate(end + (text << 40)) - (text << 40)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (begin[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return text[at].astype(np.uint32).tobytes(), begin[at].astype(np.uint32).tobytes(), np.maximum.reduceat(end, at).astype(np.uint32).tobytes()


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The byte ranges, end to end."""
    before = np.cumsum(length) - length
    return data[np.repeat(start - before, length) + np.arange(length.sum())]


def earlier(data: np.ndarray, length: np.ndarray, ids: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, begin and end of the parts of texts (end to end in data) whose windows also stand in a text of a smaller id.

    Only texts of one anchor can share windows; where all texts of an anchor are equal, their least id decides for all.
    """
    at = np.cumsum(length) - length
    names = run_hashes(data, at, at + length)
    _, sample, where = np.unique(names, return_index=True, return_inverse=True)
    least, many = np.full(len(sample), LAST), length[sample] - WIDTH + 1
    np.minimum.at(least, where, ids)
    base = np.cumsum(many) - many
    least_at = np.repeat(least, many)
    _, group, sizes = np.unique(anchor[sample], return_inverse=True, return_counts=True)
    several = np.flatnonzero(sizes[group] > 1)
    if len(several):
        windows = np.repeat(base[several] - (np.cumsum(many[several]) - many[several]), many[several]) + np.arange(int(many[several].sum()))
        least_at[windows] = least_of_windows(gathered(data, at[sample[several]], length[sample[several]]), length[sample[several]], least[several])
    own = many[where]
    entry = np.repeat(np.arange(len(length)), own)
    offset = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    lost = least_at[base[where[entry]] + offset] < ids[entry]
    begins = lost.copy()
    begins[1:] &= ~(lost[:-1] & (entry[1:] == entry[:-1]))
    ends = lost.copy()
    ends[:-1] &= ~(lost[1:] & (entry[1:] == entry[:-1]))
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    return entry[a], offset[a], offset[b] + WIDTH


def least_of_windows(data: np.ndarray, length: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every window of the texts (end to end in data), in turn, the least id of the texts that have the same window."""
    many = length - WIDTH + 1
    base = np.cumsum(length + 1) - length - 1
    s = np.ones(len(data) + len(length) + 1, np.int64)
    s[np.arange(len(data)) + np.repeat(np.arange(len(length)), length)] = data.astype(np.int64) + 2  # a separator follows each text
    s[-1] = 0
    window = np.arange(int(many.sum())) + np.repeat(base - (np.cumsum(many) - many), many)
    number = np.full(len(s), -1, np.int64)
    number[window] = np.arange(len(window))
    order = suffix_array(s, 258)
    order = order[number[order] >= 0]
    shared = permuted_common_prefixes(np.where(s >= 2, s - 2, 0).astype(np.uint8), order, WIDTH)[order]
    runs = np.flatnonzero(shared < WIDTH)
    lowest = np.minimum.reduceat(np.repeat(least, many)[number[order]], runs)
    out = np.empty(len(window), np.int64)
    out[number[order]] = np.repeat(lowest, np.diff(runs, append=len(order)))
    return out


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
