"""Repeated strings of a bounded text, by interval expansion on its Burrows-Wheeler transform.

Plain numpy, for use inside tasks. All intervals of one level are handled in a few array calls.
"""

from __future__ import annotations

import numpy as np

# UTF-8 never holds this byte; it ends every string and sorts after all others.
END = 0xFF
# Levels up to this many bytes are read off the first sort's keys.
KEY = 8


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and the sorted keys of the first eight bytes.

    Only suffixes that are still tied are sorted again.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(KEY, np.uint8)]).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for i in range(KEY):
        keys = (keys << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=first[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    step = KEY
    while len(tied):
        at = order[tied]
        ahead = at + step
        beyond = ahead >= n
        ahead[beyond] = 0
        second = np.where(beyond, 0, rank[ahead] + 1)
        both = rank[at] * np.int64(n + 1) + second
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[tied] = at
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(both[1:], both[:-1], out=new[1:])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order, sorted_keys


def common_prefixes(text: np.ndarray, order: np.ndarray, keys: np.ndarray, longest: int) -> np.ndarray:
    """Common prefixes of neighbouring suffixes, found by increasing value up to ``longest``.

    ``result[i]`` belongs to the suffixes i-1 and i; -1 stands for ``longest`` bytes or more (and
    for suffixes that run into the end of their string together). Strings of a level are the
    intervals of suffixes that start with them. Each is extended to the left by every byte found
    before its suffixes; an extended interval whose right border has no value yet fixes it, and
    is extended in turn. The levels are gone through breadth first, so the first value is right.
    """
    n = len(text)
    before = text[order - 1]  # the text ends with END, which stands before the first suffix
    by_byte = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[by_byte] = np.arange(n)
    same = before[by_byte[1:]] == before[by_byte[:-1]]
    last_one, next_one = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    last_one[by_byte[1:][same]] = by_byte[:-1][same]
    next_one[by_byte[:-1][same]] = by_byte[1:][same]
    open_ = before != END

    found = np.full(n + 1, -1, np.int16)
    found[0] = found[n] = 0
    differ = np.flatnonzero(keys[1:] != keys[:-1])
    bits = keys[differ] ^ keys[differ + 1]
    equal_bytes = np.zeros(len(bits), np.int16)
    for i in range(1, KEY):
        equal_bytes += (bits >> np.uint64(64 - 8 * i)) == 0
    found[differ + 1] = equal_bytes
    starts = np.concatenate([[0], differ + 1])
    ends = np.concatenate([differ, [n - 1]])
    key = keys[starts]
    whole = np.ones(len(key), bool)
    for i in range(KEY):
        whole &= ((key >> np.uint64(8 * i)) & np.uint64(255)) != END
    new = whole & (found[ends + 1] == KEY - 1)
    lo, hi = starts[new], ends[new]

    for level in range(KEY, longest):
        if not len(lo):
            break
        single = lo == hi
        s = lo[single]
        s = to[s[open_[s]]]
        a, b = lo[~single], hi[~single]
        sizes = b - a + 1
        total = int(sizes.sum())
        if total:
            of = np.repeat(np.arange(len(a)), sizes)
            at = np.arange(total) + np.repeat(a - (np.cumsum(sizes) - sizes), sizes)
            usable = open_[at]
            lows = np.sort(to[at[usable & (last_one[at] < a[of])]])
            highs = np.sort(to[at[usable & (next_one[at] > b[of])]])
            lo, hi = np.concatenate([s, lows]), np.concatenate([s, highs])
        else:
            lo = hi = s
        unknown = found[hi + 1] < 0
        lo, hi = lo[unknown], hi[unknown]
        found[hi + 1] = level
    return found


def repeated(strings: list[bytes], weights: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Per string the runs of bytes that lie in a string of ``length`` bytes found twice or more.

    A string of weight w counts as w equal strings. Places in different strings, or different
    places in one, count alike. Runs are (start, end).
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    order, keys = suffix_order(text)
    found = common_prefixes(text, order, keys, length)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    of = np.repeat(np.arange(len(strings)), lengths + 1)
    left = (starts + lengths)[of] - np.arange(len(text))
    weight = np.where(left >= length, np.array(weights, np.int64)[of], 0)[order]
    group = np.cumsum(found[: len(text)] >= 0) - 1
    heavy = np.bincount(group, weight).astype(np.int64) >= 2
    places = np.sort(order[heavy[group] & (weight > 0)])
    result: list[list[tuple[int, int]]] = [[] for _ in strings]
    if len(places):
        cut = np.flatnonzero((np.diff(places) > 1) | (np.diff(of[places]) > 0))
        firsts = places[np.concatenate([[0], cut + 1])]
        lasts = places[np.concatenate([cut, [len(places) - 1]])]
        for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
            base = int(starts[of[first]])
            runs = result[of[first]]
            if runs and runs[-1][1] >= first - base:
                runs[-1] = (runs[-1][0], last - base + length)
            else:
                runs.append((first - base, last - base + length))
    return result
