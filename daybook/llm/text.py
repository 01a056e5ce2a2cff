"""Words, hashes and batches that the text operators share.

A word is a maximal run of characters other than ASCII white space (space and 0x09 to 0x0D).
Python code sees texts as one flat byte buffer per slice of a batch, so that words of many texts
are found and hashed by a few NumPy calls; a slice holds ``SLICE_BYTES`` or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.session import materialise

SLICE_BYTES = 1 << 20
WHITE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, everything else unchanged."""
    return F.translate(text, _UPPER, _LOWER)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back; see ``daybook.session.materialise``."""
    return materialise(df, name)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the named column has at most ``limit`` bytes or one row in each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@dataclass
class Words:
    """Words of several texts in one buffer: spans, and the first word of every text."""

    buffer: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more than texts: words of text i are first[i]:first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Index of the text of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def find_words(texts: list[bytes]) -> Words:
    """Spans of the words of all texts."""
    buffer = b" ".join([b"", *texts, b""])
    white = _IS_WHITE[np.frombuffer(buffer, np.uint8)]
    change = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    offsets = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return Words(buffer, starts, ends, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of substrings of a sequence by prefix sums of a polynomial modulo 2^64.

    Two hashers with different seeds give independent values; both together serve as identity.
    """

    def __init__(self, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.table = random.integers(0, 1 << 64, 256, np.uint64)
        base = int(random.integers(0, 1 << 62)) * 4 + 3
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            grown = 1 << (n - 1).bit_length()
            self.up = np.full(grown, self.base, np.uint64)
            self.down = np.full(grown, self.inverse, np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for every pair; values are 64-bit."""
        self._powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts])

    def words(self, found: Words) -> np.ndarray:
        """Hash of every word."""
        return self.spans(self.table[np.frombuffer(found.buffer, np.uint8)], found.starts, found.ends)


FIRST, SECOND = Hasher(11), Hasher(23)
