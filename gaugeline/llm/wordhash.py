"""Hashes of words and of runs of words, over whole blocks of texts at once.

A block is the UTF-8 of some texts, each followed by a space.  Words are what ``[^\\x20\\x09-\\x0D]+`` matches.
Run hashes are differences of a prefix sum of word hashes times powers of an odd constant, so any run of any
length costs two look-ups, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text per block: what one worker holds in arrays at once (a longer text is a block of its own).
BLOCK_CHARS = 800_000
#: Bytes whose words are hashed at once.
HASHED_AT_ONCE = 1 << 20

_MASK = (1 << 64) - 1
_R, _Q = 0x9E3779B97F4A7C15 & ~0x7 | 0x5, 0xD1342543DE82EF95 & ~0x7 | 0x5  # odd, 5 modulo 8: powers have the longest period
_RI, _QI = pow(_R, -1, 1 << 64), pow(_Q, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as every block needs them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), dtype=np.uint64)
        have[0] = 1
        filled = 1
        while filled < len(have):
            more = min(filled, len(have) - filled)
            have[filled : filled + more] = have[:more] * np.uint64(pow(base, filled, 1 << 64))
            filled += more
        _powers[base] = have
    return have[:n]


@dataclass
class Block:
    """Words of some texts in order: hash of each, and the first word of each text (with the total as last entry).

    ``data`` holds the words' bytes, each followed by one space; word i starts at ``at[i]`` there.
    """

    hashes: np.ndarray
    first: np.ndarray
    prefix: np.ndarray
    data: np.ndarray
    at: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def part(self, lo: int, hi: int) -> Block:
        """The words from ``lo`` to ``hi``, exclusive, as one text."""
        hashes, at = self.hashes[lo:hi], self.at[lo : hi + 1]
        prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(_Q, len(hashes)), out=prefix[1:])
        return Block(hashes, np.array([0, len(hashes)]), prefix, self.data[at[0] : at[-1]], at - at[0])

    def runs(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each position; runs that cross texts are there too."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.prefix[length : length + n] - self.prefix[:n]) * powers(_QI, n))

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the words from ``lo`` to ``hi``, exclusive."""
        return mix((self.prefix[hi] - self.prefix[lo]) * powers(_QI, len(self.hashes) + 1)[lo])


def spaced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, at, first): the words' bytes, each followed by one space; where each starts, and the end; first word of each text, and the total."""
    joined = b" ".join(texts) + b" " if texts else b""
    raw = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    space = _SPACE[raw]
    before = np.ones(len(raw), dtype=bool)
    before[1:] = space[:-1]
    first = np.concatenate([[0], np.searchsorted(np.flatnonzero(before & ~space), ends)]).astype(np.int64)
    data = raw[~(space & before)]
    blank = _SPACE[data]
    data[blank] = 32
    return data, np.concatenate([[0], np.flatnonzero(blank) + 1]), first


def block_of(texts: list[bytes]) -> Block:
    """Words are hashed HASHED_AT_ONCE bytes at a time, so a very long text needs little beyond its words' hashes."""
    data, at, first = spaced(texts)
    n = len(at) - 1
    hashes = np.empty(n, dtype=np.uint64)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + HASHED_AT_ONCE, side="right")) - 1)
        piece = data[at[lo] : at[hi]]
        if len(piece) > HASHED_AT_ONCE:  # a single word
            hashes[lo] = int.from_bytes(hashlib.blake2b(piece[:-1].tobytes(), digest_size=8).digest(), "little")
        else:
            starts, ends = at[lo:hi] - at[lo], at[lo + 1 : hi + 1] - at[lo] - 1
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[piece] * powers(_R, len(piece)), out=sums[1:])
            hashes[lo:hi] = mix((sums[ends] - sums[starts]) * powers(_RI, len(piece) + 1)[starts] + (ends - starts).astype(np.uint64))
        lo = hi
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(_Q, n), out=prefix[1:])
    return Block(hashes, first, prefix, data, at)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``chars`` bytes of text each, and their texts as UTF-8; null is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(batch):
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + chars, side="right")))
            yield batch.slice(lo, hi - lo), [x or b"" for x in column.slice(lo, hi - lo).to_pylist()]
            lo = hi
