"""Token counts by compiled finite-state transducers.

Two deterministic machines replace the tokenizer library's general code:

1. The splitter, over classes of characters, marks where each pre-token begins. Its input is cut into chunks; every
   chunk yields a map from each start state to its end state, the maps are composed by a parallel prefix scan, and
   with every chunk's true start state known all chunks emit at once.
2. The merger reads a pre-token's bytes. Its state holds, for every suffix that may still grow into a longer token,
   the last token before that suffix and the count of tokens there; each transition is annotated with the change of
   the token count of the prefix read so far. The machine is determinised as texts need its states.

A prefix's last token is the longest vocabulary entry ending there that merges leave next to the token before it;
two tokens may stand side by side if encoding their joined bytes gives back exactly these two.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .shared import bounded_batches, machine, pieces, record

LIMIT = 1024
#: Classes of characters; a contraction's letters stand out of the letters.
APOSTROPHE, SPACE, BLANK, NUMBER, OTHER, LETTER = range(6)
_CONTRACTED = "stmdrevl"
#: The class that stands after each text and sends every state back to the start.
RESET = LETTER + 1 + len(_CONTRACTED)
CHUNK = 256


def byte_symbols() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary writes each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in out)
    return out | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Splitter:
    """The pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ as a machine with one character of delay.

    A state names the pre-token being read. White space is the one case decided later: the last blank of a run goes
    to the word after it if it is a space, and is a pre-token of its own otherwise.
    """

    #: start of text; in letters, digits, others; in blanks whose last is a space or not; after ' at a beginning; after 'r, 'v or 'l; contraction complete.
    START, LETTERS, DIGITS, OTHERS, ENDS_SPACE, ENDS_BLANK, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE = range(11)

    def __init__(self) -> None:
        import regex

        self.classes = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        codes = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        for kind, pattern in ((BLANK, r"\s+"), (NUMBER, r"\p{N}+"), (LETTER, r"\p{L}+")):
            for m in regex.finditer(pattern, every):
                self.classes[codes[m.start() : m.end()]] = kind
        self.classes[ord("'")], self.classes[ord(" ")] = APOSTROPHE, SPACE
        for k, c in enumerate(_CONTRACTED):
            self.classes[ord(c)] = LETTER + 1 + k
        kinds, states = RESET + 1, 11
        self.next = np.zeros((states, kinds), np.uint8)
        #: 1: a pre-token begins at this character. 2: at the one before. 4 (a contraction undone): none begins at this one, though the state says so.
        self.emit = np.zeros((states, kinds), np.uint8)
        for state in range(states):
            for kind in range(kinds):
                self.next[state, kind], self.emit[state, kind] = self.step(state, kind)

    def step(self, state: int, kind: int) -> tuple[int, int]:
        if kind == RESET:
            return self.START, 0
        letter = _CONTRACTED[kind - LETTER - 1] if kind > LETTER else ""
        whole = {SPACE: self.ENDS_SPACE, BLANK: self.ENDS_BLANK, NUMBER: self.DIGITS, OTHER: self.OTHERS, APOSTROPHE: self.OTHERS}.get(kind, self.LETTERS)
        fresh = self.QUOTE if kind == APOSTROPHE else whole
        blanks = (self.ENDS_SPACE, self.ENDS_BLANK)
        if state in blanks:
            if whole in blanks:
                return whole, 0
            # a space before the character belongs to it: then an apostrophe is an ordinary other character
            return (whole, 2) if state == self.ENDS_SPACE else (fresh, 3)
        if state == self.QUOTE and letter:
            if letter in "stmd":
                return self.DONE, 0
            if letter in "rvl":
                return {"r": self.QUOTE_R, "v": self.QUOTE_V, "l": self.QUOTE_L}[letter], 1
        if state == self.QUOTE and whole == self.OTHERS:
            return self.OTHERS, 0
        if letter and (state, letter) in ((self.QUOTE_R, "e"), (self.QUOTE_V, "e"), (self.QUOTE_L, "l")):
            return self.DONE, 4
        if state in (self.QUOTE_R, self.QUOTE_V, self.QUOTE_L) and whole == self.LETTERS:
            return self.LETTERS, 0
        if state == whole and state in (self.LETTERS, self.DIGITS, self.OTHERS):
            return state, 0
        return fresh, 1

    def begins(self, classes: np.ndarray) -> np.ndarray:
        """Positions at which pre-tokens begin, of texts end to end given by their characters' classes, with RESET after each."""
        n = len(classes)
        rows = -(-n // CHUNK)
        grid = np.full((rows, CHUNK), RESET, np.uint8)
        grid.ravel()[:n] = classes
        columns = np.ascontiguousarray(grid.T)
        states, kinds = self.next.shape
        flat = self.next.ravel().astype(np.uint16) * np.uint16(kinds)
        start = np.zeros(rows, np.uint16)
        if rows > 1:
            maps = np.repeat(np.arange(states, dtype=np.uint16)[:, None] * np.uint16(kinds), rows - 1, 1)
            for column in columns:
                maps = flat[maps + column[: rows - 1]]
            start[1:] = self.scan(maps // np.uint16(kinds))[self.START] * np.uint16(kinds)
        emitted = np.empty((CHUNK, rows), np.uint8)
        flat_emit, state = self.emit.ravel(), start
        for j, column in enumerate(columns):
            at = state + column
            emitted[j] = flat_emit[at]
            state = flat[at]
        marks = emitted.T.ravel()[:n]
        here = (marks & 1) > 0
        here[:-1] |= (marks[1:] & 2) > 0
        here[np.flatnonzero(marks & 4) - 1] = False  # the letter after the apostrophe was taken for a new word
        return np.flatnonzero(here)

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition of the maps in the columns, in a logarithmic number of rounds."""
        maps, step = maps.copy(), 1
        while step < maps.shape[1]:
            maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], 0)
            step *= 2
        return maps


class Merger:
    """Byte-pair merges as a transducer over bytes, determinised on demand.

    A state lists, longest first, each suffix of the bytes read that begins some token: its node in the trie of tokens,
    the last token before it (-1 at the beginning) and the tokens up to there less the tokens of the whole.
    """

    #: States kept; a machine that outgrows them starts anew, with the same counts.
    KEPT = 250_000

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        to_byte = {c: b for b, c in byte_symbols().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = [raw(s) for s in vocabulary]
        #: Trie: node * 256 + byte gives the child; node 0 is the root. token_at: the token that ends at a node, or -1.
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for number, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[key]
            self.token_at[node] = number
        self.fits: dict[int, bool] = {}
        self.grown: dict[int, tuple[list, list] | None] = {}
        self.restart()

    def restart(self) -> None:
        self.states: list[tuple[int, ...]] = [(0, -1, 0)]
        self.number = {self.states[0]: 0}
        #: From state * 256 + byte to next state * 256 + 128 + change of the count.
        self.moves: dict[int, int] = {}

    def edges(self, token: int) -> tuple[list, list] | None:
        """How the first and the last part of a token's own bytes grow while they are merged: (part, rank of the merge that consumes it).

        The best-ranked adjacent pair merges, leftmost first. None if the merges do not lead back to the token.
        """
        if token not in self.grown:
            raw, never = self.tokens[token], len(self.rank) + 1
            parts = [raw[k : k + 1] for k in range(len(raw))]
            first, last = [], []
            while len(parts) > 1:
                best, k = min((self.rank.get(p, never), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
                if best == never:
                    break
                if k == 0:
                    first.append((parts[0], best))
                if k == len(parts) - 2:
                    last.append((parts[-1], best))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.grown[token] = ([*first, (raw, never)], [*last, (raw, never)]) if len(parts) == 1 else None
        return self.grown[token]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merges leave both tokens when they are joined: no pair across the seam may merge before its parts grow."""
        key = (left + 1) << 20 | right
        found = self.fits.get(key)
        if found is None:
            found = self.edges(right) is not None and (left < 0 or self.seam_holds(self.edges(left)[1], self.edges(right)[0]))
            if len(self.fits) > 2 * self.KEPT:
                self.fits = {}
            self.fits[key] = found
        return found

    def seam_holds(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            if (rank := self.rank.get((a, b))) is not None and rank < a_ends and rank <= b_ends:
                return False
            if a_ends <= b_ends and i + 1 < len(left):
                i += 1
            elif j + 1 < len(right):
                j += 1
            else:
                return True

    def move(self, state: int, byte: int) -> int:
        """The next state and the change of the token count, as moves holds them."""
        held, child, token_at = self.states[state], self.child, self.token_at
        grown, token, change = [], -1, 0
        for k in range(0, len(held), 3):
            node = child.get(held[k] << 8 | byte)
            if node is not None:
                last, less = held[k + 1], held[k + 2]
                if token < 0 <= token_at[node] and self.side_by_side(last, token_at[node]):
                    token, change = token_at[node], less + 1
                grown.append((node, last, less))
        live = tuple(x for node, last, less in grown for x in (node, last, less - change)) + (0, token, 0)
        number = self.number.get(live)
        if number is None:
            number = self.number[live] = len(self.states)
            self.states.append(live)
        out = self.moves[state << 8 | byte] = number << 8 | change + 128
        return out

    def count(self, raw: bytes) -> int:
        if len(self.states) > self.KEPT:
            self.restart()
        state, total, moves = 0, -128 * len(raw), self.moves
        for byte in raw:
            found = moves.get(state << 8 | byte)
            if found is None:
                found = self.move(state, byte)
            state = found >> 8
            total += found & 255
        return total


class Counter:
    """Counts of whole texts, as the library's file defines them; special strings count as one token each."""

    #: Pre-token counts kept by a worker: of so many recent ones, and of so many before them.
    KEPT = 200_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        self.splitter, self.merger = Splitter(), Merger(spec["model"]["vocab"], spec["model"]["merges"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.older.get(word)
            if n is None:
                n = self.merger.count(word.encode("utf-8", "surrogatepass"))
            if len(self.known) >= self.KEPT:
                self.known, self.older = {}, self.known
            if len(word) <= 64:
                self.known[word] = n
        return n

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of the texts; the splitter reads them all in one go."""
        totals, parts, owners = np.zeros(len(texts), np.int64), [], []
        for k, text in enumerate(texts):
            split = [text]
            if self.special and self.special.search(text):
                totals[k] += len(self.special.findall(text))
                split = self.special.split(text)
            parts += split
            owners += [k] * len(split)
        joined = "\n".join(parts) + "\n"
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.splitter.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        classes[ends] = RESET
        at = self.splitter.begins(classes)
        owner = np.searchsorted(ends, at)
        stop = np.append(at[1:], len(joined))
        stop = np.minimum(stop, ends[owner]).tolist()
        words = [joined[a:b] for a, b in zip(at.tolist(), stop, strict=True)]
        found = list(map(self.known.get, words))
        if None in found:
            found = [self.count(w) if n is None else n for w, n in zip(words, found, strict=True)]
        totals += np.bincount(np.asarray(owners, np.int64)[owner], weights=np.asarray(found, np.float64), minlength=len(texts)).astype(np.int64)[: len(texts)]
        return totals.tolist()


def counter(path: str) -> Counter:
    """One compiled machine for each Python worker."""
    return machine(("counter", path), lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have 0 tokens; very long texts are counted whole; ids may be null or repeated, each row is counted
    by itself; other columns, whatever their names, are not looked at; an empty table gives no rows. No shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            totals = [n for a, b in pieces(sizes) for n in machine.counts(texts[a:b])]
            yield record(schema, batch.column(0), sizes, totals, [n > limit for n in totals])

    bounded_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by byte_bpe_50k.json."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
