"""Suffix arrays by induced sorting, in vector operations: a bucket's entries induce their neighbours all at once."""

from __future__ import annotations

import numpy as np

from .kernel import U64, mix

#: Alphabets up to this size are induced bucket by bucket; the names of a reduced string are ranked by doubling.
BUCKETS = 1024


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Starts of all suffixes in order; s holds numbers below size and ends in the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    if size > BUCKETS:
        return doubled(s)
    differ = np.flatnonzero(s[:-1] != s[1:])
    smaller = np.empty(n, bool)  # S suffixes: smaller than the next one
    smaller[:-1] = np.repeat(s[differ] < s[differ + 1], np.diff(differ, prepend=-1))
    smaller[-1] = True
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sort = Inducer(s, smaller, size)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    by_substring = sort.induce(leftmost)
    by_substring = by_substring[is_leftmost[by_substring]]
    reduced, names = named(s, leftmost, by_substring)
    if names < len(leftmost):
        order = leftmost[suffix_array(reduced, names)]
    else:
        order = by_substring
    return sort.induce(order)


def named(s: np.ndarray, leftmost: np.ndarray, by_substring: np.ndarray) -> tuple[np.ndarray, int]:
    """The leftmost-smaller substrings' names in order of the text: equal ones, next to each other in order, share one."""
    length = np.empty(len(s), np.int32)
    length[leftmost] = np.diff(leftmost, append=len(s))
    length[leftmost[:-1]] += 1  # they overlap by a character
    power = np.cumprod(np.full(len(s), 0x9E3779B97F4A7C15, U64))
    sums = np.zeros(len(s) + 1, U64)
    np.cumsum(mix(s.astype(U64) + U64(1)) * power, out=sums[1:])
    power = np.cumprod(np.full(len(s), pow(0x9E3779B97F4A7C15, -1, 2**64), U64))
    own = length[by_substring]
    value = (sums[by_substring + own] - sums[by_substring]) * power[by_substring]
    new = np.ones(len(by_substring), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    name = np.empty(len(s), np.int32)
    name[by_substring] = np.cumsum(new) - 1
    return name[leftmost].astype(np.int64), int(new.sum())


def doubled(s: np.ndarray) -> np.ndarray:
    """Suffixes in order by ranks of prefixes whose length doubles until all differ."""
    rank, step = s.astype(U64), 1
    while True:
        after = np.zeros(len(s), U64)
        after[:-step] = rank[step:] + U64(1)
        key = rank << U64(32) | after
        order = np.argsort(key)
        new = np.ones(len(s), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        if new.all():
            return order
        rank[order] = (np.cumsum(new) - 1).astype(U64)
        step *= 2


class Inducer:
    """Places all suffixes from an order of the leftmost smaller ones: larger ones by a scan upwards, smaller ones by a scan downwards."""

    def __init__(self, s: np.ndarray, smaller: np.ndarray, size: int) -> None:
        self.s, self.smaller, self.size = s.astype(np.uint16), smaller, size
        counts = np.bincount(s, minlength=size)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.larger = np.bincount(s[~smaller], minlength=size)
        self.used = np.flatnonzero(counts).tolist()

    def push(self, batch: np.ndarray, kind: bool) -> None:
        """Put the suffixes one to the left, if of this kind, at the free ends of their buckets."""
        before = batch - 1
        before = before[before >= 0] if len(batch) and batch.min() == 0 else before
        before = before[self.smaller[before] == kind]
        if not len(before):
            return
        char = self.s[before]
        order = np.argsort(char, kind="stable")
        before, char = before[order], char[order]
        first = np.concatenate([[0], np.flatnonzero(char[1:] != char[:-1]) + 1])
        own, many = char[first], np.diff(first, append=len(char))
        if kind:
            at = np.repeat(self.free[own] - 1 + first, many) - np.arange(len(char))
            self.free[own] -= many
        else:
            at = np.repeat(self.free[own] - first, many) + np.arange(len(char))
            self.free[own] += many
        self.out[at] = before

    def induce(self, order: np.ndarray) -> np.ndarray:
        s, out = self.s, np.zeros(len(self.s), np.int32)
        self.out, self.free = out, self.starts.copy()
        chars = s[order]
        grouped = order[np.argsort(chars, kind="stable")]
        cut = np.concatenate([[0], np.cumsum(np.bincount(chars, minlength=self.size))]).tolist()
        starts, ends = self.starts.tolist(), self.ends.tolist()
        for c in self.used:
            done = starts[c]
            while done < (upto := int(self.free[c])):
                self.push(out[done:upto], False)
                done = upto
            if cut[c] < cut[c + 1]:
                self.push(grouped[cut[c] : cut[c + 1]], False)
        self.free = self.ends.copy()
        out[0], self.free[0] = len(s) - 1, 0
        for c in reversed(self.used):
            done = ends[c]
            while c and done > (downto := int(self.free[c])):
                self.push(out[downto:done][::-1], True)
                done = downto
            larger = int(self.larger[c])
            if larger:
                self.push(out[starts[c] : starts[c] + larger][::-1], True)
        return out


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there, as a number; zeros follow the end."""
    out, padded = np.zeros(len(data), U64), np.concatenate([data, np.zeros(8, data.dtype)]).astype(U64)
    for j in range(8):
        out |= padded[j : j + len(data)] << U64(8 * j)
    return out


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """In order of the text (only at the places in order): the bytes shared with the place before in order, counted by eights, at most width.

    Whether width is reached is exact: the last eight bytes end there.
    """
    word, out = eight_bytes(data), np.zeros(len(data), np.int32)
    here, there, shared = order[1:], order[:-1], 0
    while len(here):
        at = min(shared, width - 8)
        same = (here + at < len(data)) & (there + at < len(data))
        same[same] = word[here[same] + at] == word[there[same] + at]
        here, there, shared = here[same], there[same], min(shared + 8, width)
        out[here] = shared
        if shared == width:
            break
    return out
