"""Suffix arrays and common prefixes of byte strings, in numpy."""

import numpy as np


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in sorted order, by Larsson and Sadakane's refinement.

    Suffixes are sorted by their first 8 bytes. Then only groups that are still equal are sorted
    further, each by the ranks that its suffixes have as many bytes later as are sorted already, so
    the sorted length doubles with each round. A rank is the place where the group begins, so ranks
    outside the groups never change. A suffix sorts before those that it begins.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    words = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    first = np.ones(n, bool)
    if (data[-8:] == 0).any():
        # A NUL byte and the end of the data look alike in a word; shorter suffixes come first.
        left = np.minimum(np.arange(n, 0, -1), 8)
        order = np.lexsort((left, words))
        first[1:] = (np.diff(left[order]) != 0) | (words[order][1:] != words[order][:-1])
    else:
        order = np.argsort(words, kind="stable")
        first[1:] = words[order][1:] != words[order][:-1]
    begin = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = begin[np.cumsum(first) - 1]
    sorted_to = 8
    single = first & np.append(first[1:], True)
    places = np.flatnonzero(~single)  # in the order, of groups that are not single
    while len(places):
        suffixes = order[places]
        later = suffixes + sorted_to
        second = np.where(later < n, rank[np.minimum(later, n - 1)], -1)
        group = rank[suffixes]
        by = np.argsort(group * (n + 1) + second + 1, kind="stable")
        suffixes, group, second = suffixes[by], group[by], second[by]
        order[places] = suffixes
        first = np.ones(len(places), bool)
        first[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        # A group's places are consecutive, so a new group begins at the place of its first one.
        rank[suffixes] = places[np.flatnonzero(first)[np.cumsum(first) - 1]]
        single = first & np.append(first[1:], True)
        places = places[~single]
        sorted_to *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix shares with the one before it in the order (0 for the
    first), by Kasai's rule.

    The rule: a suffix shares at least one byte less than the suffix one byte earlier did. Where the
    bytes before the two suffixes differ it has nothing to build on; only there bytes are compared,
    eight at a time for all such places together. Everywhere else the rule holds with equality.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    known = np.arange(1, n)
    pair = before[known]
    fresh[1:] = (pair <= 0) | (data[known - 1] != data[np.maximum(pair - 1, 0)])
    i = np.flatnonzero(fresh & (before >= 0))
    j = before[i]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    length = np.zeros(len(i), np.int64)
    active = np.arange(len(i))
    while len(active):
        a, b = i[active] + length[active], j[active] + length[active]
        differ = words[a] ^ words[b]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        room = n - np.maximum(a, b)
        length[active] += np.minimum(same, room)
        active = active[(same == 8) & (room > 8)]
    prefix = np.zeros(n, np.int64)
    prefix[i] = length
    # Carry on from the last place where bytes were compared.
    base = np.where(fresh, np.arange(n), 0)
    base = np.maximum.accumulate(base)
    prefix = np.maximum(prefix[base] - (np.arange(n) - base), 0)
    prefix[before < 0] = 0
    out[:] = prefix[order]
    return out


def equal_classes(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes, and for each the number of its class: equal numbers mean equal first
    `depth` bytes (for suffixes that long)."""
    order = suffix_array(data)
    shared = common_prefixes(data, order)
    return order, np.cumsum(shared < depth)
