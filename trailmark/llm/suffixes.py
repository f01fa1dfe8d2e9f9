"""Suffix arrays by induced sorting, and common prefixes of neighbours.

Suffixes are smaller (S) or larger (L) than the one after them. The leftmost S suffixes of every run
(LMS) split the text into substrings; their order, found by inducing once and, where names repeat,
by sorting the string of names in the same way, induces the order of all suffixes in two passes.
With few symbols the passes go bucket by bucket over whole arrays; a string of many names is done
one by one.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `s` in order. `s` holds non-negative integers and ends with its only 0."""
    symbols = int(s.max()) + 1 if len(s) else 0
    if len(s) < 3:
        return np.argsort(s, kind="stable")
    if symbols * 60 > len(s) * 2.5:
        return np.array(_one_by_one(s.tolist(), symbols), np.int64)
    return _by_bucket(s, symbols)


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is."""
    n = len(s)
    rises, falls = s[:-1] < s[1:], s[:-1] > s[1:]
    # The next position that differs decides for a run of equal symbols.
    at = np.where(rises | falls, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(rises, True)[nearest], True)


def _by_bucket(s: np.ndarray, symbols: int) -> np.ndarray:
    n = len(s)
    small = _smaller(s)
    lms = np.append(False, small[1:] & ~small[:-1])
    sizes = np.bincount(s, minlength=symbols)
    starts = np.cumsum(sizes) - sizes
    key = s.astype(np.uint16) if symbols < 1 << 16 else s

    def place(sa, positions, at, up):
        """Puts positions into their buckets in the order given, upwards or downwards from `at`."""
        symbol = key[positions]
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order].astype(np.int64)
        count = np.bincount(symbol, minlength=symbols)
        rank = np.arange(len(order)) - (np.cumsum(count) - count)[symbol]
        if up:
            sa[at[symbol] + rank] = positions[order]
            at += count
        else:
            sa[at[symbol] - 1 - rank] = positions[order]
            at -= count

    def before(found, kind):
        p = found[found > 0] - 1
        return p[small[p] == kind]

    def induced(sorted_lms: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int64)
        by_symbol = np.argsort(key[sorted_lms], kind="stable")
        in_order = sorted_lms[by_symbol]
        bounds = np.searchsorted(s[in_order], np.arange(symbols + 1))
        head = starts.copy()
        for c in range(symbols):
            done = starts[c]
            while done < head[c]:
                found, done = sa[done : head[c]].copy(), head[c]
                place(sa, before(found, False), head, True)
            if bounds[c + 1] > bounds[c]:
                place(sa, before(in_order[bounds[c] : bounds[c + 1]], False), head, True)
        tail = starts + sizes
        for c in range(symbols - 1, -1, -1):
            done = starts[c] + sizes[c]
            if c == 0:
                break  # the end symbol alone: nothing is smaller
            while done > tail[c]:
                found, done = sa[tail[c] : done][::-1].copy(), tail[c]
                place(sa, before(found, True), tail, False)
            if head[c] > starts[c]:
                place(sa, before(sa[starts[c] : head[c]][::-1].copy(), True), tail, False)
        sa[0] = n - 1
        return sa

    positions = np.flatnonzero(lms)
    first = induced(positions)
    in_order = first[lms[first]]
    # Equal LMS substrings get equal names: same length, same symbols.
    ends = np.append(positions[1:], n - 1)
    end_of = np.zeros(n, np.int64)
    end_of[positions] = ends
    a, b = in_order[:-1], in_order[1:]
    length = end_of[a] - a
    same = length == end_of[b] - b
    active, k = np.flatnonzero(same), 0
    while len(active):
        differs = s[a[active] + k] != s[b[active] + k]
        same[active[differs]] = False
        active = active[~differs]
        active = active[length[active] > k]
        k += 1
    names = np.append(0, np.cumsum(~same))
    if names[-1] + 1 < len(in_order):
        name_of = np.zeros(n, np.int64)
        name_of[in_order] = names
        in_order = positions[suffix_array(name_of[positions])]
    return induced(in_order)


def _one_by_one(s: list[int], symbols: int) -> list[int]:
    n = len(s)
    small = [True] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    sizes = [0] * symbols
    for c in s:
        sizes[c] += 1
    firsts, lasts, total = [], [], 0
    for size in sizes:
        firsts.append(total)
        total += size
        lasts.append(total)

    def induced(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = lasts[:]
        for i in reversed(order):
            c = s[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = firsts[:]
        for k in range(n):
            j = sa[k] - 1
            if j >= 0 and not small[j]:
                c = s[j]
                sa[head[c]] = j
                head[c] += 1
        tail = lasts[:]
        for k in range(n - 1, -1, -1):
            j = sa[k] - 1
            if j >= 0 and small[j]:
                c = s[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    end_of, name_of = [0] * n, [0] * n
    for i, end in zip(lms, [*lms[1:], n - 1]):
        end_of[i] = end
    name, last, in_order = -1, None, []
    for i in induced(lms):
        if end_of[i]:
            piece = s[i : end_of[i] + 1]
            if piece != last:
                name, last = name + 1, piece
            name_of[i] = name
            in_order.append(i)
    if name + 1 < len(lms):
        in_order = [lms[k] for k in suffix_array(np.array([name_of[i] for i in lms], np.int64)).tolist()]
    return induced(in_order)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For k > 0, the common prefix of suffixes sa[k - 1] and sa[k]; 0 first.

    Computed in text order: where the symbols before a suffix and before its neighbour agree, the value
    is one less than that of the position before; only the others are compared.
    """
    n = len(s)
    neighbour = np.empty(n, np.int64)
    neighbour[sa[0]] = -1
    neighbour[sa[1:]] = sa[:-1]
    at = np.arange(n)
    follows = (at > 0) & (neighbour > 0)
    follows[follows] = s[at[follows] - 1] == s[neighbour[follows] - 1]
    value = np.zeros(n, np.int64)
    start = np.flatnonzero(~follows & (neighbour >= 0))
    active, k = start, 0
    while len(active):
        a, b = active + k, neighbour[active] + k
        inside = (a < n) & (b < n)
        active, a, b = active[inside], a[inside], b[inside]
        active = active[s[a] == s[b]]
        k += 1
        value[active] = k
    anchor = np.maximum.accumulate(np.where(~follows, at, 0))
    value = np.maximum(value[anchor] - (at - anchor), 0)
    out = value[sa]
    out[0] = 0
    return out
