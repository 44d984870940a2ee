"""Language identification by language-bitmask n-gram filters.

One Bloom filter in bit-sliced layout serves all languages: each slot is a mask with a bit for each language, and the
AND of an n-gram's slots gives all languages that contain it. A document's hits are counted for each language, corrected
for the rate at which that language's bit is set by chance, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import U64, mix
from .shared import bounded_batches, machine, pieces, record, width

#: The classifier is fitted on about so many documents of each language (a hash of the id picks them), in whole.
SAMPLED = 2000
ORDERS = (3, 4, 5)
#: Slots of the filter (a power of two) and probes for each n-gram.
SLOTS, PROBES = 1 << 21, 3
#: An n-gram belongs to a language that has it at least so often, and at this share of its largest rate in any language.
LEAST, SHARE = 3, 0.2
UNKNOWN = "und"
#: Values of lang that a filter is built for, since it holds a bit for each in every slot and the driver the sample's counts for all.
MOST_LANGUAGES = 1024


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ORDERS, hashed byte n-grams of the letters (lower-cased, other characters as one space), and their text's index."""
    raw = [(" " + t.lower() + " ").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    other = (data < 128) & ~((data >= 97) & (data <= 122))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    keep = ~other
    keep[1:] |= ~other[:-1]
    keep[0] = True
    keep[np.cumsum(sizes)[:-1]] = True  # each text begins with a space
    data, owner = np.where(other, np.uint8(32), data)[keep], owner[keep]
    for n in ORDERS:
        packed = np.zeros(max(len(data) - n + 1, 0), U64)
        for j in range(n):
            packed = packed << U64(8) | data[j : len(packed) + j]
        same = owner[n - 1 :] == owner[: len(packed)]
        yield mix(packed[same] + U64(n << 56)), owner[: len(packed)][same]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Filter:
    """The bit-sliced Bloom filter: words of 64 languages side by side."""

    def __init__(self, languages: list[str], slots: int = SLOTS) -> None:
        self.languages, self.planes = languages, np.zeros((-(-max(len(languages), 1) // 64), slots), U64)

    def probes(self, keys: np.ndarray) -> list[np.ndarray]:
        step = (keys >> U64(32)) | U64(1)
        return [((keys + U64(k) * step) & U64(self.planes.shape[1] - 1)).astype(np.int64) for k in range(PROBES)]

    def add(self, keys: np.ndarray, language: int) -> None:
        plane, bit = self.planes[language // 64], U64(1) << U64(language % 64)
        for at in self.probes(keys):
            plane[at] |= bit  # the same bit in each: repeated slots do no harm

    def chance(self) -> np.ndarray:
        """For each language the rate at which an n-gram that it lacks seems to be there."""
        return np.array([((self.planes[k // 64] >> U64(k % 64)) & U64(1)).mean() ** PROBES for k in range(len(self.languages))])

    def hits(self, keys: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Hits by text and language."""
        at, out = self.probes(keys), np.zeros((texts, len(self.languages)))
        masks = [np.bitwise_and.reduce([plane[a] for a in at]) for plane in self.planes]
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner[((masks[k // 64] >> U64(k % 64)) & U64(1)).astype(bool)], minlength=texts)
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and share of the text's n-grams that it holds, corrected for chance; without letters UNKNOWN and 0."""
        lettered = [has_letter(t) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, hits, chance = np.zeros((len(texts), 1)), np.zeros((len(texts), len(self.languages))), self.chance_kept
        for keys, owner in grams([t if ok else "" for t, ok in zip(texts, lettered, strict=True)]):
            total[:, 0] += np.bincount(owner, minlength=len(texts))
            hits += self.hits(keys, owner, len(texts))
        held = np.clip((hits - total * chance) / (1 - chance) / np.maximum(total, 1), 0, 1)
        best = held.argmax(1)
        score = held[np.arange(len(texts)), best]
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]

    def frozen(self) -> Filter:
        self.chance_kept = np.minimum(self.chance(), 0.99)
        return self


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo of; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


def fit(docs: DataFrame, learnt: Column, *, sampled: int = SAMPLED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter:
    """Fit on a bounded sample of the rows for which learnt holds and text and language are not null.

    The counts of n-grams are made where the rows are and added up in shards; the driver gets those of the sample only.
    """
    spark = docs.sparkSession
    known = docs.filter(learnt & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not languages:
        return Filter([]).frozen()
    share = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, min(1.0, sampled / sizes[lang]))])
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(drawn < F.element_at(share, F.col(lang_col))).select(F.element_at(number, F.col(lang_col)).alias("k"), F.col(text_col).alias("text"))
    shards = width(spark)
    schema = pa.schema([("shard", pa.int32()), ("k", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            of, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for k in np.unique(of).tolist():
                own = [texts[j] for j in np.flatnonzero(of == k)]
                for a, b in pieces([len(t) for t in own]):
                    for keys, _ in grams(own[a:b]):
                        held[k] = added(*held.get(k, (np.zeros(0, U64), np.zeros(0, np.int64))), *np.unique(keys, return_counts=True))
        rows = [(s, k, keys[mine].tobytes(), counts[mine].tobytes()) for k, (keys, counts) in held.items() for s in range(shards) if (mine := (keys % U64(shards)).astype(np.int64) == s).any()]
        yield record(schema, *([list(c) for c in zip(*rows, strict=True)] or [[]] * 4))

    out = pa.schema([("grams", pa.binary()), ("languages", pa.binary()), ("counts", pa.binary())])
    many = len(languages)

    def add_up(table: pa.Table) -> pa.Table:
        """Only counts that are not zero, of n-grams that some language has often enough."""
        held = {}
        for k, keys, counts in zip(*(table.column(c).to_pylist() for c in ("k", "grams", "counts")), strict=True):
            held[k] = added(*held.get(k, (np.zeros(0, U64), np.zeros(0, np.int64))), np.frombuffer(keys, U64), np.frombuffer(counts, np.int64))
        keys, counts = (np.concatenate([x[c] for x in held.values()]) for c in range(2))
        of = np.repeat(np.array(list(held), np.int32), [len(x[0]) for x in held.values()])
        often = np.isin(keys, np.unique(keys[counts >= LEAST]))
        return pa.table([[keys[often].tobytes()], [of[often].tobytes()], [counts[often].tobytes()]], schema=out)

    rows = sample.mapInArrow(count, "shard int, k int, grams binary, counts binary").groupBy("shard").applyInArrow(add_up, "grams binary, languages binary, counts binary").collect()
    keys, of, counts = (np.concatenate([np.frombuffer(r[c], t) for r in rows] or [np.zeros(0, t)]) for c, t in (("grams", U64), ("languages", np.int32), ("counts", np.int64)))
    rates = counts / np.maximum(np.bincount(of, weights=counts, minlength=many), 1)[of]
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0])) if len(keys) else np.zeros(0, np.int64)
    highest = np.empty(len(keys))
    highest[order] = np.repeat(np.maximum.reduceat(rates[order], first) if len(keys) else rates, np.diff(np.append(first, len(keys))))
    chosen = (counts >= LEAST) & (rates >= SHARE * highest)
    model = Filter(languages)
    for k in range(many):
        model.add(keys[chosen & (of == k)], k)
    return model.frozen()


def added(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts m of keys a and n of keys b as counts of distinct keys."""
    keys, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([m, n]), minlength=len(keys)).astype(np.int64)


def judged(docs: DataFrame, model: Filter, *, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score beside their own columns; own columns of these two names are replaced."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    plain = docs.select(*names)
    text_at = names.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine(("language",))
        for batch in batches:
            texts, langs, scores = batch.column(text_at).to_pylist(), [], []
            for a, b in pieces([len(t or "") for t in texts], 1 << 18):
                for column, values in zip((langs, scores), shared.value.decide(texts[a:b]), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    return plain.mapInArrow(judge, T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_id(docs: DataFrame, *, of: int = 4, held: int = 2, sampled: int = SAMPLED) -> DataFrame:
    """For every row doc_id, held_out, lang_pred and score (0 to 1); learnt from rows whose crc32(doc_id) mod of is not held.

    Null texts and texts without a letter are "und" with score 0. A null doc_id is neither learnt from nor held out.
    Repeated rows are judged alike, very long texts whole; with nothing to learn from, every row is "und". Ties go to the
    first language by name. Other columns, whatever their names, are not looked at. An empty table gives no rows; over MOST_LANGUAGES languages are an error.
    """
    model = fit(docs, remainder("doc_id", of) != held, sampled=sampled)
    out = F.coalesce(remainder("doc_id", of) == held, F.lit(False))
    return judged(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
