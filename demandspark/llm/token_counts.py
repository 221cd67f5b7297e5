"""Token counts by a tokenizer compiled to finite-state transducers.

Byte-pair encoding of a piece of text is compiled to a deterministic transducer over bytes. Its state
holds what the future can depend on: the longest suffix read that may still grow into a token, the last
token of the encoding that ends at each place of that suffix, and the token counts there relative to
now. Reading a byte emits the change of the number of tokens. (The last token of a prefix is the one
suffix token that is compatible with the last token before it; see ``Transducer.step``.) States are
compiled when first met and kept in a dense table.

Pieces begin where the tokenizer's pattern begins them, which a table of character classes decides from
a character's neighbours. A piece's begin resets the transducer.

Texts are cut into chunks that run side by side through the table, one byte at a time. A chunk does not know
the state it is entered in, so its result is a state map: what lies before its first reset is its
head, the rest has a fixed count and a fixed end state (no reset: the head is all of it). Maps of
neighbours compose to maps, so the chunks of a document are reduced by a parallel scan: pairs, then pairs
of pairs, with each head run once from the state to its left.

Defined cases: null and empty texts have 0 tokens. The strings of added tokens are cut out first and
count one each, as in the library. Repeated documents are counted one by one; empty tables give empty
results, further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.tables import ids_and_texts, small_batches, utf8

#: Length of a chunk in bytes.
CHUNK = 256
START, UNKNOWN = 0, 1


class TableFull(Exception):
    """More states than the table may hold."""


class Transducer:
    """Lazily compiled counts for a byte-level BPE of the tokenizers library's JSON format."""

    def __init__(self, path: str, most_entries: int = 1 << 25):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bytes_of = self.alphabet()
        decode = lambda t: bytes(bytes_of[c] for c in t)
        self.added = [t["content"] for t in spec["added_tokens"]]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(decode(a), decode(b)): k for k, (a, b) in enumerate(merges)}
        tokens = {decode(t) for t in spec["model"]["vocab"] if t not in self.added}
        self.tokens = {t for t in tokens if self.merge(t) == [t]}
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.most_entries, self.columns = most_entries, 128
        self.clear()

    @staticmethod
    def alphabet() -> dict[str, int]:
        """The printable stand-in of every byte in vocabulary files: itself, or 256 and up in order."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def clear(self) -> None:
        """Forget all states but the first two. The table holds next state * 256 + change of count + 128;
        it has a column for each byte met so far, in order, and room for 128 or 256."""
        self.states = [(b"", (None,), (0,)), None]
        self.number = {self.states[0]: START}
        self.table = np.full((1024, self.columns), -1, np.int32)
        self.table[UNKNOWN] = UNKNOWN * 256 + 128
        self.bytes, self.column = [], np.full(256, -1, np.int64)

    def in_columns(self, data: np.ndarray) -> np.ndarray:
        """The column of each byte."""
        new = [b for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist() if self.column[b] < 0]
        if len(self.bytes) + len(new) > self.columns:
            self.columns = 256
            self.clear()
            return self.in_columns(data)
        self.column[new] = np.arange(len(self.bytes), len(self.bytes) + len(new))
        self.bytes += new
        return self.column.astype(np.uint8)[data]

    def merge(self, text: bytes) -> list[bytes]:
        """Plain BPE of a short string."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, left: bytes | None, right: bytes) -> bool:
        """Whether ``right`` can follow ``left`` in an encoding; anything can follow the start."""
        if left is None:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after one more byte, and the change of the number of tokens.

        The encoding of a prefix ends in some token t, and before t stands the encoding of the prefix
        without t. So t is the suffix that is a token and is compatible with the last token before it.
        """
        suffix, lasts, counts = state
        grown = suffix + bytes([byte])
        for i in range(len(grown)):
            if grown[i:] in self.tokens and self.compatible(lasts[i], grown[i:]):
                break
        else:
            raise ValueError(f"no token ends in byte {byte}")
        change = counts[i] + 1
        cut = next(k for k in range(len(grown) + 1) if grown[k:] in self.prefixes)
        lasts = (*lasts, grown[i:])[cut:]
        counts = tuple(c - change for c in (*counts, change))[cut:]
        return (grown[cut:], lasts, counts), change

    def compile(self, places: np.ndarray) -> None:
        """Fill the given places (state * columns + column) of the table."""
        for place in places.tolist():
            state, column = divmod(place, self.columns)
            following, change = self.step(self.states[state], self.bytes[column])
            n = self.number.get(following)
            if n is None:
                n = self.number[following] = len(self.states)
                self.states.append(following)
                if n * self.columns >= self.most_entries:
                    raise TableFull
                if n >= len(self.table):
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.table.ravel()[place] = n * 256 + change + 128

    def run(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray, resets: np.ndarray | None):
        """Read ``size`` bytes from ``at`` on, for all lanes side by side: counts and last states."""
        order = np.argsort(-size, kind="stable")
        at, state, left = at[order], state[order].astype(np.int32), size[order]
        count = np.zeros(len(at), np.int64)
        lanes = len(at) - np.searchsorted(left[::-1], np.arange(1, (left[0] if len(left) else 0) + 1))
        for k, n in enumerate(lanes.tolist()):
            place = at[:n] + k
            now = state[:n]
            if resets is not None:
                now = np.where(resets[place], START, now)
            where = now * self.columns + data[place]
            entry = self.table.ravel()[where]
            missing = entry < 0
            if missing.any():
                self.compile(np.unique(where[missing]))
                entry = self.table.ravel()[where]
            state[:n] = entry >> 8
            count[:n] += (entry & 255) - 128
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return count[back], state[back]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text (bytes between two offsets), special strings read as ordinary text."""
        resets = piece_starts(data, offsets)
        data = self.in_columns(data)
        size = np.diff(offsets)
        chunks = -(-size // CHUNK)
        doc = np.repeat(np.arange(len(size)), chunks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        at = offsets[doc] + nth * CHUNK
        end = np.minimum(at + CHUNK, offsets[doc + 1])
        firsts = np.append(np.flatnonzero(resets), len(data))
        head = np.minimum(firsts[np.searchsorted(firsts, at)], end) - at
        # state maps of single chunks
        fixed, last = self.run(data, at, end - at, np.full(len(at), UNKNOWN), resets)
        known = head < end - at
        # up the tree: the left one of each pair takes in the right one
        while len(doc) and nth.max() > 0:
            right = np.flatnonzero(nth % 2 == 1)
            left = right - 1
            joined = known[left]
            more, state = self.run(data, at[right[joined]], head[right[joined]], last[left[joined]], None)
            a, b = left[joined], right[joined]
            fixed[a] += more + fixed[b]
            last[a] = np.where(known[b], last[b], state)
            a, b = left[~joined], right[~joined]
            head[a] += head[b]
            fixed[a], last[a], known[a] = fixed[b], last[b], known[b]
            kept = nth % 2 == 0
            doc, nth, at, head = doc[kept], nth[kept] // 2, at[kept], head[kept]
            fixed, last, known = fixed[kept], last[kept], known[kept]
        out = np.zeros(len(size), np.int64)
        out[doc] = fixed
        return out

    def one_by_one(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Like :meth:`counts`, without a table: for texts that need more states than fit."""
        resets = piece_starts(data, offsets)
        out = np.zeros(len(offsets) - 1, np.int64)
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            state = self.states[START]
            for i in range(a, b):
                state, change = self.step(self.states[START] if resets[i] else state, int(data[i]))
                out[k] += change
        return out

    def bounded_counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """:meth:`counts`, in smaller parts if the table gets full."""
        try:
            return self.counts(data, offsets)
        except TableFull:
            self.clear()
        n = len(offsets) - 1
        if n == 1:
            return self.one_by_one(data, offsets)
        half = offsets[n // 2]
        parts = (data[:half], offsets[: n // 2 + 1]), (data[half:], offsets[n // 2 :] - half)
        return np.concatenate([self.bounded_counts(*p) for p in parts])


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@cache
def classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks every byte at which a piece begins under the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    out = np.zeros(len(data), bool)
    if not len(data):
        return out
    places = np.flatnonzero((data & 0xC0) != 0x80)  # of the characters
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = classes()[chars]
    n = len(chars)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(places, offsets[:-1])] = True  # an empty text marks its successor, first anyway
    first[n] = True
    opens, closes = first[:-1], first[1:]
    before = np.where(opens, 255, np.concatenate([[255], kind[:-1]])).astype(np.uint8)
    after = np.where(closes, 255, np.concatenate([kind[1:], [255]])).astype(np.uint8)
    blank = chars == 32
    space = kind == SPACE
    # runs of one class; the last character of white space before other text is a piece of its own ...
    start = kind != before
    start |= space & (after != SPACE) & (after != 255)
    # ... or, if it is a blank, leads the piece that follows
    led = np.zeros(n, bool)
    led[1:] = blank[:-1] & ~space[1:] & ~opens[1:]
    start &= ~led
    # contractions: a lone apostrophe that begins a piece takes one or two letters along
    quote = np.flatnonzero((chars == 39) & start & (after == LETTER))
    if len(quote):
        padded = np.append(chars, [0, 0]).astype(np.uint32)
        inside = ~np.append(first[:-1], [True, True, True])
        a, b = padded[quote + 1], np.where(inside[quote + 2], padded[quote + 2], 0)
        single = np.isin(a, [ord(c) for c in "stmd"])
        double = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            double |= (a == ord(x)) & (b == ord(y))
        for found, length in ((single, 1), (double & ~single, 2)):
            at = quote[found]
            start[at + 1] = False
            rest = at + 1 + length
            rest = rest[(rest < n)]
            rest = rest[(kind[rest] == LETTER) & ~opens[rest]]
            start[rest] = True
    out[places[start]] = True
    return out


@cache
def transducer(path: str) -> Transducer:
    """One table for all tasks of a Python worker."""
    return Transducer(path)


def counts_of(texts: pa.Array, machine: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text, strings of added tokens counting one."""
    data, offsets = utf8(texts)
    size = np.diff(offsets)
    raw = data.tobytes()
    special = [t.encode() for t in machine.added if t.encode() in raw]
    if not special:
        return size, machine.bounded_counts(data, offsets)
    cut = regex.compile(b"|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
    parts, doc, extra = [], [], np.zeros(len(size), np.int64)
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        own = cut.split(raw[a:b])
        extra[k] = len(own) - 1
        parts += own
        doc += [k] * len(own)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    found = machine.bounded_counts(np.frombuffer(b"".join(parts), np.uint8), at)
    return size, extra + np.bincount(doc, found, minlength=len(size)).astype(np.int64)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path)
        for batch in small_batches(batches, "text"):
            size, tokens = counts_of(batch.column("text"), machine)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
