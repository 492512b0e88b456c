"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A separator is always an ASCII byte, so words are found bytewise and no text is
decoded. Texts are taken in slices of about ``SLICE_BYTES`` (a longer text makes
a slice of its own, whole), which bounds the memory of a task whatever the size
of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_A_TO_Z = range(0x41, 0x5B)


def _alphabet(is_word, lower: bool) -> np.ndarray:
    """Byte to byte: 0 for a separator, else the (lower-cased) byte."""
    table = np.array([b if is_word(b) else 0 for b in range(256)], dtype=np.uint8)
    if lower:
        for b in _A_TO_Z:
            if table[b]:
                table[b] = b + 32
    return table


def _not_space(b: int) -> bool:
    return b != 0x20 and not 0x09 <= b <= 0x0D


def _alphanumeric(b: int) -> bool:
    return b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A


#: ``[^\x20\x09-\x0D]+`` as it stands. A NUL is a word character: it becomes byte 1's
#: neighbour 0xFF, which no UTF-8 text holds.
PLAIN = _alphabet(_not_space, lower=False)
PLAIN[0] = 0xFF
#: The same with A-Z lower-cased.
LOWER = _alphabet(_not_space, lower=True)
LOWER[0] = 0xFF
#: Runs of ASCII letters, digits and everything beyond ASCII, A-Z lower-cased.
ALNUM = _alphabet(_alphanumeric, lower=True)

_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM_STEP = np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values; ``salt`` picks another one."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a slice of texts: byte ranges in ``data``, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), self.counts())

    def hashes(self, alphabet: np.ndarray) -> np.ndarray:
        """64-bit hash of each word, over its bytes in ``alphabet``."""
        out = np.zeros(len(self.starts), dtype=np.uint64)
        at, left, rows = self.starts, self.ends - self.starts, None
        power = np.uint64(1)
        with np.errstate(over="ignore"):
            while len(at):
                value = _BYTE_VALUES[alphabet[self.data[at]]] * power
                if rows is None:
                    out += value
                    rows = np.arange(len(out))
                else:
                    out[rows] += value
                power = power * _STEP
                more = left > 1
                at, left, rows = at[more] + 1, left[more] - 1, rows[more]
        return mix(out)


def find_words(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    inside = alphabet[data] != 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that begin at each place, over place boundaries of texts too;
    the last ``n - 1`` places have none."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    total, width, power, offset = None, 1, _GRAM_STEP, 0
    block, left = hashes, n
    scale = np.uint64(1)
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = block[offset : offset + len(hashes) - n + 1] * scale
                total = part if total is None else total + part
                offset += width
                scale = scale * power
            left >>= 1
            if left:
                block = block[: len(block) - width] + block[width:] * power
                width, power = 2 * width, power * power
    return mix(total)


def gram_places(first: np.ndarray, n: int) -> np.ndarray:
    """Places at which ``n`` words of one text begin."""
    counts = np.diff(first)
    room = np.maximum(counts - n + 1, 0)
    total = int(room.sum())
    shift = np.repeat(first[:-1] - (np.cumsum(room) - room), room)
    return np.arange(total) + shift


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, bytes, offsets)`` for runs of texts of an Arrow column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if len(column) == 0:
        return
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, everything[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Consecutive runs of ``values``, ``counts[i]`` of them in row ``i``."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
