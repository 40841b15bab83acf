"""Sets of word shingles and their partition signatures, for many texts at once (inside a task)."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from anomaloom.llm.hashing import BASE_A, BASE_B, U64, RangeHashes, Texts, gram_hashes, mix

#: Parts beyond the number of differences: a set with that many empty parts is still regular.
SPARE_PARTS = 2


@dataclass
class Sets:
    """Distinct shingle hashes of texts, text by text in rising order; ``bounds`` cuts the texts."""

    members: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.sizes)

    def of(self, index: int) -> np.ndarray:
        return self.members[self.bounds[index] : self.bounds[index + 1]]


def shingle_sets(texts: Texts, size: int, lower: bool = True) -> Sets:
    """Distinct ``size``-word shingles; a shorter text's whole word sequence; none without words."""
    starts, ends, text = texts.words()
    hashes = texts.word_hashes(starts, ends, lower)
    counts = np.bincount(text, minlength=len(texts))
    last = np.cumsum(counts)
    grams = gram_hashes(hashes, size, BASE_A)
    whole = np.flatnonzero(text[: len(grams)] == text[size - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    ranges = RangeHashes(hashes, BASE_A).of(last[short] - counts[short], last[short])
    members = np.concatenate([grams[whole], ranges])
    owner = np.concatenate([text[whole], short])
    order = np.argsort(members)
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    members, owner = members[order], owner[order]
    new = np.ones(len(members), dtype=bool)
    new[1:] = (members[1:] != members[:-1]) | (owner[1:] != owner[:-1])
    members, owner = members[new], owner[new]
    sizes = np.bincount(owner, minlength=len(texts))
    return Sets(members, np.concatenate([[0], np.cumsum(sizes)]))


def set_keys(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """128-bit key of every set as two signed longs; equal sets have equal keys."""
    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(values)])
        return sums[sets.bounds[1:]] - sums[sets.bounds[:-1]]

    sizes = sets.sizes.astype(U64)
    a = mix(total(mix(sets.members + U64(BASE_A))) + sizes)
    b = mix(total(mix(sets.members ^ U64(BASE_B))) ^ sizes)
    return a.view(np.int64), b.view(np.int64)


@lru_cache(maxsize=64)
def _bands(percent: int, upto: int) -> list[int]:
    """Lower ends of the size bands: partners are in a set's own band or a neighbouring one."""
    lows = [1]
    while lows[-1] <= upto:
        lows.append(lows[-1] * 100 // percent + 1)
    return lows


@lru_cache(maxsize=200_000)
def band_of(size: int, percent: int) -> int:
    upto = 1 << 12
    while upto <= size:
        upto <<= 2
    return bisect_right(_bands(percent, upto), size) - 1


@lru_cache(maxsize=10_000)
def most_differences(band: int, percent: int) -> int:
    """Largest symmetric difference of a similar pair whose smaller set lies in ``band``."""
    upto = 1 << 12
    while len(_bands(percent, upto)) < band + 2:
        upto <<= 2
    high = _bands(percent, upto)[band + 1] - 1
    return high * (100 - percent) // percent


def signatures(sets: Sets, percent: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures ``(signature, set number)`` of the ``wanted`` sets (a boolean mask).

    Similar sets share at least one. A set signs in two instances, that of its size band (with
    larger partners) and the one below (with smaller ones). In an instance the domain is cut by
    hash into k + 1 + spare parts, k being the most differences of a similar pair, so that the pair
    agrees on all but k parts. A set signs with its non-empty parts, and with the empty ones too only
    if at most k are non-empty: a similar pair then always shares a signature, and few sets
    sign with an empty part.
    """
    found, owners = [], []
    sizes, owner = sets.sizes, sets.owner
    bands = np.array([band_of(int(n), percent) if n else -1 for n in sizes], dtype=np.int64)
    for back in (0, 1):
        use = wanted & (bands - back >= 0)
        if not use.any():
            continue
        instance = np.where(use, bands - back, 0)
        k = np.array([most_differences(int(i), percent) if u else 0 for i, u in zip(instance, use)], dtype=np.int64)
        parts = np.where(use, k + 1 + np.where(k > 0, SPARE_PARTS, 0), 0)
        salt = mix((instance + 1).astype(U64) * U64(BASE_B))
        offset = np.concatenate([[0], np.cumsum(parts)])
        mine = use[owner]
        members, own = sets.members[mine], owner[mine]
        spread = mix(members ^ salt[own])
        part = ((spread >> U64(32)) * parts[own].astype(U64)) >> U64(32)
        cell = offset[own] + part.astype(np.int64)
        sums = np.zeros(offset[-1], dtype=U64)
        np.add.at(sums, cell, mix(spread + U64(BASE_A)))
        full = np.bincount(cell, minlength=offset[-1]) > 0
        cell_owner = np.repeat(np.arange(len(sizes)), parts)
        filled = np.bincount(cell_owner[full], minlength=len(sizes))
        keep = full | (filled <= k)[cell_owner]
        number = (np.arange(offset[-1]) - offset[cell_owner]).astype(U64)
        signed = mix(sums + mix(number * U64(BASE_A) + salt[cell_owner]))
        found.append(signed[keep])
        owners.append(cell_owner[keep])
    if not found:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(owners)


#: Cells of the sketches of sets of up to ``CELLS[n]`` members per 8 cells; larger sets have the last.
CELLS = (64, 256, 1024, 4096)


def sketches(sets: Sets, wanted: np.ndarray) -> list[bytes | None]:
    """Members per hash cell of the ``wanted`` sets, at most 255, one byte a cell.

    The cells of two sets differ by no more than the sets do, so the sum of the cells' differences
    is a lower bound of the symmetric difference. Larger sets have more cells, so that it stays sharp.
    """
    finest = CELLS[-1]
    cell = (mix(sets.members + U64(BASE_B)) >> U64(64 - finest.bit_length() + 1)).astype(np.int64)
    found: list[bytes | None] = []
    for i, size in enumerate(sets.sizes.tolist()):
        if not wanted[i]:
            found.append(None)
            continue
        cells = next((c for c in CELLS if size <= 8 * c), finest)
        mine = cell[sets.bounds[i] : sets.bounds[i + 1]] // (finest // cells)
        found.append(np.minimum(np.bincount(mine, minlength=cells), 255).astype(np.uint8).tobytes())
    return found


class SketchTable:
    """Sketches of many sets; a pair is compared in rising numbers of cells, as far as both have them."""

    def __init__(self, raw: list[bytes], sizes: np.ndarray) -> None:
        self.sizes = sizes
        cells = np.array([len(r) for r in raw], dtype=np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for level in CELLS:
            rows = np.flatnonzero(cells >= level)
            if not len(rows):
                break
            place = np.full(len(raw), -1, dtype=np.int64)
            place[rows] = np.arange(len(rows))
            table = np.stack(
                # At most 64 times 255, so 16 bits hold a cell of the coarsest level too.
                [np.frombuffer(raw[i], np.uint8).reshape(level, -1).sum(axis=1, dtype=np.int16) for i in rows]
            )
            self.levels.append((place, table))

    def near(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of rows sizes and sketches do not rule out."""
        total = self.sizes[i] + self.sizes[j]
        near = 100 * np.minimum(self.sizes[i], self.sizes[j]) >= percent * np.maximum(self.sizes[i], self.sizes[j])
        for place, table in self.levels:
            look = np.flatnonzero(near)
            a, b = place[i[look]], place[j[look]]
            both = (a >= 0) & (b >= 0)
            look, a, b = look[both], a[both], b[both]
            if not len(look):
                break
            for part in range(0, len(look), 50_000):
                at = slice(part, part + 50_000)
                apart = np.abs(table[a[at]] - table[b[at]]).sum(axis=1)
                near[look[at]] = (100 + percent) * apart <= (100 - percent) * total[look[at]]
        return near


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union, of rising distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)
