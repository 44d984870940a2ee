"""Vectorised text primitives on the byte buffers of Arrow string columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(0, 2**63, 256).astype(U64) * U64(2) + U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that separate words: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, end to end, and the n + 1 offsets of the strings in them; null counts as empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """multiplier ** i and its inverse ** i modulo 2 ** 64, for i up to n; kept for the worker's life."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _MULTIPLIER, U64), np.full(size, pow(_MULTIPLIER, -1, 2**64), U64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes: differences, times an inverse power, are hashes of ranges. For short ranges only, as long patterns can be made to meet."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


#: Bytes of a range that run_hashes mixes eight at a time; longer ranges, few in running text, are hashed by BLAKE2.
MIXED = 128
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_SECOND = 0xD6E8FEB86659FD93


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges from a state of 128 bits.

    Every eight bytes enter both halves, mixed in the second and not in the first, so bytes chosen to make one half meet
    leave the other apart. Where hashes never leave a process, a random key keeps texts from being built for it at all.
    """
    size = ends - starts
    first, second = mix(size.astype(U64) + U64(_MULTIPLIER) + U64(key)), mix((size.astype(U64) ^ U64(key)) + U64(_SECOND))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    own = np.flatnonzero(size <= MIXED)
    for at in range(0, MIXED, 8):
        own = own[size[own] > at]
        if not len(own):
            break
        block = eight[starts[own] + at] & _TAIL[np.minimum(size[own] - at, 8)]
        first[own] = mix((first[own] ^ block) * U64(_MULTIPLIER) + U64(at + 1))
        second[own] = (second[own] ^ mix(block + U64(_SECOND))) * U64(_MULTIPLIER) + (second[own] >> U64(29))
    out = mix(first + mix(second))
    long = np.flatnonzero(size > MIXED)
    if len(long):
        raw, salt = data.tobytes(), key.to_bytes(8, "little")
        out[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, key=salt).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of bytes other than those between words, within each string, and the index of the word at which each string begins."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:-1] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all strings with A-Z lower-cased, and the index of each string's first word (n + 1 entries)."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    return run_hashes(data, starts, ends), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words within each string, and their string's index; a shorter non-empty string is one run as a whole."""
    counts = np.diff(first)
    weights = mix(np.arange(1, width + 1, dtype=U64) * U64(_MULTIPLIER)) | U64(1)
    runs = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), runs)
    out = np.zeros(0, U64)
    if len(owner):
        total = np.zeros(len(hashes) - width + 1, U64)
        for j in range(width):
            total += hashes[j : len(hashes) - width + 1 + j] * weights[j]
        before = np.cumsum(runs) - runs
        out = mix(total[np.arange(len(owner)) - before[owner] + first[owner]])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), U64)
        for j in range(width - 1):
            has = counts[short] > j
            whole[has] += hashes[first[short[has]] + j] * weights[j]
        out = np.concatenate([out, mix(whole + counts[short].astype(U64))])
        owner = np.concatenate([owner, short])
    return out, owner


def distinct_per_owner(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values in ascending order, end to end, and the n + 1 offsets of the owners."""
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    at = np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[at]
