"""Suffix arrays by linear grouping.

Suffixes are first grouped by their longest Lyndon prefix: groups are taken from the greatest down,
every suffix of a group points to the nearest suffix before it in a smaller group, and the suffixes
pointed at grow by the group's prefix, those pointed at more often becoming greater. Then the
order inside the groups comes from one pass over the array, without renaming or recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Starts of the suffixes of ``symbols`` (integers) in rising order; a shorter prefix is smaller."""
    n = len(symbols)
    if not n:
        return []
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    heads = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
    tails = np.concatenate([heads[1:], [n]])
    first = np.repeat(heads, tails - heads)
    group_of = np.empty(n, dtype=np.int64)
    group_of[order] = first
    place_of = np.empty(n, dtype=np.int64)
    place_of[order] = np.arange(n)
    group, place, members = group_of.tolist(), place_of.tolist(), order.tolist()
    end = [0] * (n + 1)  # of the group that starts here
    start_at = [0] * (n + 1)  # of the group that ends here
    for low, high in zip(heads.tolist(), tails.tolist()):
        end[low] = high
        start_at[high] = low
    before = [-1] * n  # nearest smaller suffix to the left
    high = n
    while high:
        low = start_at[high]
        inside = sorted(members[low:high]) if high - low > 1 else (members[low],)
        times: dict[int, int] = {}
        for i in inside:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        high = low
        if not times:
            continue
        if len(times) == 1:
            _split(times, group, place, members, end, start_at)
            continue
        by_times: dict[int, list[int]] = {}
        for j, count in times.items():
            by_times.setdefault(count, []).append(j)
        for count in sorted(by_times, reverse=True):
            _split(by_times[count], group, place, members, end, start_at)
    return _ordered(n, group, before)


def _split(chosen, group, place, members, end, start_at) -> None:
    """Take the chosen suffixes out of their groups, into new groups right behind them."""
    opened: dict[int, int] = {}
    for j in chosen:
        low = group[j]
        high = end[low]
        if low not in opened:
            opened[low] = high
        high -= 1
        end[low] = high
        at, other = place[j], members[high]
        members[at], members[high] = other, j
        place[other], place[j] = at, high
    for low, high in opened.items():
        cut = end[low]
        if cut == low:
            end[low] = high
            continue
        end[cut] = high
        start_at[high] = cut
        start_at[cut] = low
        for at in range(cut, high):
            group[members[at]] = cut


def _ordered(n: int, group: list[int], before: list[int]) -> list[int]:
    result = [-1] * n
    free = group[:]  # indexed by group start: next free place
    for low in set(group):
        free[low] = low
    placed = bytearray(n)
    j = n - 1  # the empty suffix is the smallest; its left neighbour comes first
    for i in range(-1, n):
        if i >= 0:
            j = result[i] - 1
        while j >= 0 and not placed[j]:
            low = group[j]
            at = free[low]
            result[at] = j
            free[low] = at + 1
            placed[j] = 1
            j = before[j]
    return result


def longest_repeats(symbols: np.ndarray, order: list[int]) -> np.ndarray:
    """For every suffix the length of its longest common prefix with any other suffix."""
    n = len(symbols)
    text = symbols.tolist()
    rank = [0] * n
    for place, i in enumerate(order):
        rank[i] = place
    shared = [0] * (n + 1)  # with the next smaller suffix, by rank
    h = 0
    for i in range(n):
        place = rank[i]
        if place:
            j = order[place - 1]
            top = n - max(i, j)
            while h < top and text[i + h] == text[j + h]:
                h += 1
            shared[place] = h
            if h:
                h -= 1
        else:
            h = 0
    shared = np.array(shared)
    longest = np.zeros(n, dtype=np.int64)
    longest[np.array(order, dtype=np.int64)] = np.maximum(shared[:-1], shared[1:])
    return longest
