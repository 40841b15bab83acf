"""Vectorised 64-bit hashing of words, n-grams and byte strings of many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK = (1 << 64) - 1
# Odd multipliers: any odd value with well-mixed bits works.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (multiply-shift finaliser)."""
    values = values ^ (values >> U64(30))
    values *= U64(0xBF58476D1CE4E5B9)
    values ^= values >> U64(27)
    values *= U64(0x94D049BB133111EB)
    values ^= values >> U64(31)
    return values


def _byte_table(seed: int, lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U64) * U64(seed))
    if lower:
        table[65:91] = table[97:123]
    return table


BYTES_A, BYTES_B = _byte_table(BASE_A, False), _byte_table(BASE_B, False)
_BYTES_LOWER = _byte_table(BASE_A, True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def gram_hashes(symbols: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` symbols, by doubling."""
    if len(symbols) < length:
        return np.zeros(0, dtype=U64)
    power, size, piece = base, 1, symbols
    done: np.ndarray | None = None
    covered, left = 0, length
    while left:
        if left & 1:
            if done is None:
                done, covered = piece, size
            else:
                # The finished part follows the new piece: piece * base^covered + done.
                shift = U64(pow(base, covered, 1 << 64))
                n = len(symbols) - size - covered + 1
                done = piece[:n] * shift + done[size : size + n]
                covered += size
        left >>= 1
        if left:
            n = len(piece) - size
            piece = piece[:n] * U64(power) + piece[size : size + n]
            power = power * power & MASK
            size *= 2
    return mix(done[: len(symbols) - length + 1])


#: Bytes of a word or piece from which on its hash is a digest: polynomials modulo 2^64 agree on some
#: long texts of two letters (the Thue-Morse word and its complement) whatever the base.
LONG_BYTES = 128


def digest_long(hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``hashes`` with a 64-bit digest of the bytes in the places of long ranges."""
    long = np.flatnonzero(ends - starts >= LONG_BYTES)
    for at, start, end in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
        hashes[at] = int.from_bytes(hashlib.blake2b(data[start:end].tobytes(), digest_size=8).digest(), "little")
    return hashes


class RangeHashes:
    """Hash of any range of a symbol array from one running sum."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, base: int) -> None:
        powers, self.inverse = self._power_tables(base, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, dtype=U64)
        np.cumsum(symbols * powers[: len(symbols)], out=self.sums[1:])

    @classmethod
    def _power_tables(cls, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        tables = cls._tables.get(base)
        if tables is None or len(tables[0]) < size:
            made = []
            for factor in (base, pow(base, -1, 1 << 64)):
                table = np.full(max(size, 1 << 16), factor, dtype=U64)
                table[0] = 1
                made.append(np.multiply.accumulate(table))
            tables = cls._tables[base] = (made[0], made[1])
        return tables

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Texts:
    """Some neighbouring texts of a batch: their bytes in one array, ``first`` the first one's row."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the words.

        A word is a run of bytes other than blank, tab, LF, VT, FF and CR, within one text.
        """
        n = len(self.data)
        blank = _BLANK[self.data]
        before, after = np.ones(n + 1, dtype=bool), np.ones(n + 1, dtype=bool)
        before[1:] = blank
        after[:-1] = blank
        before[self.bounds] = True
        after[self.bounds] = True
        starts = np.flatnonzero(~blank & before[:-1])
        ends = np.flatnonzero(~blank & after[1:]) + 1
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit hash of every word; ``lower`` takes A-Z as a-z."""
        table = _BYTES_LOWER if lower else BYTES_A
        hashes = RangeHashes(table[self.data], BASE_B).of(starts, ends)
        return digest_long(hashes, _LOWER[self.data] if lower else self.data, starts, ends)


def texts_of(column: pa.BinaryArray, most_bytes: int = 1 << 19, most_texts: int = 50_000) -> Iterator[Texts]:
    """Cut a binary column into pieces of about ``most_bytes``; a longer text is a piece by itself."""
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(bounds, bounds[low] + most_bytes, side="right")) - 1
        high = min(max(high, low + 1), len(column), low + most_texts)
        yield Texts(low, data[bounds[low] : bounds[high]], (bounds[low : high + 1] - bounds[low]).astype(np.int64))
        low = high


#: Grams that are numbered at a time, in the low bits of their hashes; a power of two.
MOST_GRAMS = 1 << 24


def anchor_runs(
    grams: np.ndarray, width: int, last_start: np.ndarray, text: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed anchors: ``(anchor, first, last)`` of every run of windows with the same anchor.

    A window is ``width`` neighbouring grams; its anchor is the position of its smallest hash, the
    leftmost of equal ones. The choice looks at the window's content alone, so equal windows have
    their anchor at the same offset. ``first`` and ``last`` are window starts. Windows start at
    ``p <= last_start[text[p]]`` only, so that none crosses the end of its text. Arrays of any length
    are taken: longer ones than ``MOST_GRAMS`` in slices that share ``width - 1`` grams.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(grams) < width:
        return none, none, none
    if width > MOST_GRAMS:
        raise ValueError(f"windows of {width} grams; at most {MOST_GRAMS} can be numbered")
    step = MOST_GRAMS - width + 1
    least = np.concatenate(
        [_anchors(grams[at : at + MOST_GRAMS], width) + at for at in range(0, len(grams) - width + 1, step)]
    )
    starts = np.flatnonzero(np.arange(len(least)) <= last_start[text[: len(least)]])
    if not len(starts):
        return none, none, none
    least, owner = least[starts], text[starts]
    cuts = np.flatnonzero((least[1:] != least[:-1]) | (owner[1:] != owner[:-1])) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [len(least)]]) - 1
    return least[first], starts[first], starts[last]


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Anchor of every window of at most ``MOST_GRAMS`` grams."""
    low = U64(MOST_GRAMS - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=U64)
    return (sliding_minimum(keyed, width) & low).astype(np.int64)
