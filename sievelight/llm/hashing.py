"""Vectorised word and byte hashing for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time, whatever the size of its Arrow batches.
SLICE_BYTES = 2 << 20

#: Bytes whose words are hashed from one run of prefix sums, and the longest word hashed that way (see ByteHasher).
WORD_BLOCK = 1 << 16
LONG_WORD = 255

_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def slices(batches: Iterator[pa.RecordBatch], *size_of: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most `limit` bytes in the named text or binary columns; a longer row is a piece of its own."""
    for batch in batches:
        sizes = sum(pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(int) for c in size_of)
        start = total = 0
        for at, size in enumerate(sizes):
            if at > start and total + size > limit:
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += int(size)
        if len(sizes) > start:
            yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; a null text is empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def hash_words(words: list) -> np.ndarray:
    """One 64-bit value per word, the same in every process; distinct words are hashed once."""
    if not words:
        return np.empty(0, np.uint64)
    array = np.empty(len(words), object)
    array[:] = words
    return pd.util.hash_array(array, categorize=True)


def word_lists(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts one after the other, and the offset of each text's first word.

    A word is `[^\\x20\\x09-\\x0D]+`, which is what bytes.split() gives; bytes.lower() changes A-Z only. No word becomes an
    object: hashes come from prefix sums over blocks of bytes, those of words above LONG_WORD bytes from the words.
    """
    whole = b" ".join([b"", *texts, b""])
    whole = whole.lower() if lower else whole
    data = np.frombuffer(whole, np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    hashes, at = np.empty(len(starts), np.uint64), 0
    hasher = _word_hasher()
    while at < len(starts):
        begin = starts[at]
        to = int(np.searchsorted(ends, begin + WORD_BLOCK, "right"))
        if to > at:
            sums = hasher.prefix(data[begin : ends[to - 1]])
            hashes[at:to] = hasher.between(sums, starts[at:to] - begin, ends[at:to] - begin)
        at = max(to, at + 1)
    long_ = np.flatnonzero(ends - starts > LONG_WORD)
    hashes[long_] = hash_words([whole[starts[k] : ends[k]] for k in long_.tolist()])
    return hashes, np.searchsorted(starts, np.cumsum([1, *[len(t) + 1 for t in texts]]))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A value for each run of `n` consecutive word hashes, over the whole array."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    count = len(words) - n + 1
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = (total ^ words[k : k + count]) * _ODD
        total ^= total >> np.uint64(29)
    return mix(total)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """A value for one whole short sequence; its length counts."""
    total = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            total = (total ^ w) * _ODD
            total ^= total >> np.uint64(29)
    return mix(np.array([total], np.uint64))[0]


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct `n`-word shingles of each text, lower-cased; a shorter text is one shingle, one without words none."""
    words, offsets = word_lists(texts, lower=True)
    grams = ngram_hashes(words, n)
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        if end - start >= n:
            ordered = np.sort(grams[start : end - n + 1])
            yield ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
        elif end > start:
            yield np.array([sequence_hash(words[start:end])], np.uint64)
        else:
            yield np.empty(0, np.uint64)


class ByteHasher:
    """Hashes of any substring of a byte string, from prefix sums modulo 2^64 over random values of the bytes.

    Strings of up to a few hundred bytes only: beyond a thousand, chosen texts can be made to collide.
    """

    BASE = 0xD1342543DE82EF95  # odd, so that its powers can be undone

    def __init__(self, limit: int):
        inverse = pow(self.BASE, -1, 1 << 64)
        self.table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = self._powers(self.BASE, limit + 1), self._powers(inverse, limit + 1)

    @staticmethod
    def _powers(base: int, count: int) -> np.ndarray:
        out = np.full(count, np.uint64(base % (1 << 64)))
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _ODD)


@cache
def _word_hasher() -> ByteHasher:
    return ByteHasher(WORD_BLOCK)


class StretchHasher:
    """Hashes of byte strings that can be put together: two polynomials modulo 2^31 - 1, packed in 62 bits.

    A string's hash follows from the hashes of its parts and the powers that belong to their lengths. The bases are fixed,
    so texts can be made to collide; two texts of a megabyte that weren't do with a chance below one in a million.
    """

    PRIME = np.uint64((1 << 31) - 1)
    BASES = (1_166_083_219, 1_785_264_691)

    def __init__(self):
        self.powers, self.backs = ([np.ones(1, np.uint64) for _ in self.BASES] for _ in range(2))

    def _grow(self, size: int) -> None:
        for k, base in enumerate(self.BASES):
            for table, by in ((self.powers, base), (self.backs, pow(base, -1, int(self.PRIME)))):
                while len(table[k]) < size:
                    step = np.uint64(pow(by, len(table[k]), int(self.PRIME)))
                    table[k] = np.concatenate([table[k], table[k] * step % self.PRIME])

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, power) of the strings of `data` between neighbouring `ends`.

        Byte k of a string counts with the k-th power. Products stay below 2^40, so sums over 16 MB stay below 2^64; for
        more bytes remainders are summed.
        """
        sizes, at = np.diff(ends), ends - ends[0]
        self._grow(int(at[-1]) + 1)
        data = data[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
        hashes, powers = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        for power, back in zip(self.powers, self.backs, strict=True):
            sums = np.zeros(len(data) + 1, np.uint64)
            terms = data * power[: len(data)]
            np.cumsum(terms % self.PRIME if len(data) > 1 << 24 else terms, out=sums[1:])
            # The powers count from the first byte of all; what stands before a string is taken back.
            whole = (sums[at[1:]] - sums[at[:-1]]) % self.PRIME * back[at[:-1]] % self.PRIME
            hashes, powers = hashes << np.uint64(31) | whole, powers << np.uint64(31) | power[sizes]
        return hashes.view(np.int64), powers.view(np.int64)

    @classmethod
    def joined(cls, parts: Column) -> Column:
        """The hash of the strings side by side whose structs of `hash` and `power` are in the array, as a struct of its halves."""
        prime = F.lit(int(cls.PRIME)).cast("long")

        def half(x: Column, k: int) -> Column:
            return F.shiftright(x, 31) if k == 0 else x.bitwiseAND(prime)

        def put(state: Column, part: Column) -> Column:
            sums = [((state[f"h{k}"] + state[f"p{k}"] * half(part["hash"], k)) % prime).alias(f"h{k}") for k in (0, 1)]
            return F.struct(*sums, *[(state[f"p{k}"] * half(part["power"], k) % prime).alias(f"p{k}") for k in (0, 1)])

        none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        return F.aggregate(parts, F.struct(none.alias("h0"), none.alias("h1"), one.alias("p0"), one.alias("p1")), put)
