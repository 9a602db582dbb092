"""Suffix arrays by induced sorting at every level of the recursion, and common prefixes in text order.

Strings of few symbols are induced with numpy, a bucket in waves; of many symbols (names of substrings, from the second level on) place by place.
"""

from __future__ import annotations

import numpy as np

#: Buckets of fewer places than this, on average, are induced place by place instead of in waves, as are strings with longer runs of one symbol.
WAVE = 1 << 8


def s_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The end of the string is smaller than any symbol."""
    n = len(s)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    change = np.flatnonzero(s[1:] != s[:-1])  # last places of runs
    rising = np.append(s[change] < s[change + 1], False)  # the last run falls to the end
    runs = np.diff(np.concatenate(([0], change + 1, [n])))
    return np.repeat(rising, runs)


def _spread(symbols: np.ndarray, heads: np.ndarray, step: int) -> np.ndarray:
    """The slots of new entries of the buckets, in order; heads move on by step."""
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_symbols[1:] != sorted_symbols[:-1])))
    counts = np.diff(np.append(first, len(symbols)))
    rank = np.arange(len(symbols)) - np.repeat(first, counts)
    out = np.empty(len(symbols), np.int64)
    out[order] = heads[sorted_symbols] + step * rank
    heads[sorted_symbols[first]] += step * counts
    return out


def induce(s: np.ndarray, types: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffixes in the order that the given order of leftmost-smaller ones induces: larger types forwards, smaller ones backwards.

    starts: where each symbol's bucket begins, and the end. A bucket is taken in waves: entries that follow from its own
    ones are the next wave.
    """
    n, k = len(s), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    by = np.argsort(s[lms], kind="stable")
    lms = lms[by]
    lms_cut = np.searchsorted(s[lms], np.arange(k + 1))
    heads = starts[:-1].copy()
    # the last suffix follows from the end of the string
    sa[heads[s[n - 1]]] = n - 1
    heads[s[n - 1]] += 1
    for c in range(k):
        at = starts[c]
        while True:
            wave = sa[at : heads[c]]
            at = heads[c]
            final = not len(wave)
            if final:
                wave = lms[lms_cut[c] : lms_cut[c + 1]]
            j = wave - 1
            j = j[j >= 0]
            j = j[~types[j]]
            if len(j):
                sa[_spread(s[j], heads, 1)] = j
            if final:
                break
    larger = heads.copy()
    tails = starts[1:] - 1
    for c in range(k - 1, -1, -1):
        at = starts[c + 1] - 1
        while True:
            wave = sa[tails[c] + 1 : at + 1][::-1]
            at = tails[c]
            final = not len(wave)
            if final:
                wave = sa[starts[c] : larger[c]][::-1]
            j = wave - 1
            j = j[j >= 0]
            j = j[types[j]]
            if len(j):
                sa[_spread(s[j], tails, -1)] = j
            if final:
                break
    return sa


def induce_singly(s: np.ndarray, types: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same place by place, in time linear in the string whatever its symbols."""
    n = len(s)
    # the place before each one if it is larger, or if it is smaller; else -1, as at -1
    before = np.arange(-1, n - 1)
    rising = np.append(False, types[:-1])
    larger, smaller = np.where(rising, -1, before), np.where(rising, before, -1)
    symbols = s.tolist()
    sa = [-1] * n
    ends = (starts[1:] - 1).tolist()
    for j in lms[::-1].tolist():
        c = symbols[j]
        sa[ends[c]] = j
        ends[c] -= 1
    heads = starts[:-1].tolist()
    c = symbols[n - 1]
    # the last suffix follows from the end of the string
    sa[heads[c]] = n - 1
    heads[c] += 1
    follows = [*larger.tolist(), -1]
    for j in sa:  # reads what is set meanwhile
        j = follows[j]
        if j >= 0:
            c = symbols[j]
            at = heads[c]
            sa[at] = j
            heads[c] = at + 1
    tails = (starts[1:] - 1).tolist()
    follows = [*smaller.tolist(), -1]
    for j in reversed(sa):
        j = follows[j]
        if j >= 0:
            c = symbols[j]
            at = tails[c]
            sa[at] = j
            tails[c] = at - 1
    return np.array(sa, np.int64)


def _same(s: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Are s[a:a + length] and s[b:b + length] equal?"""
    same = np.ones(len(a), bool)
    left = np.flatnonzero(lengths > 0)
    d = 0
    while len(left):
        if len(left) <= 64:  # a few, however long
            for i in left.tolist():
                same[i] = np.array_equal(s[a[i] + d : a[i] + lengths[i]], s[b[i] + d : b[i] + lengths[i]])
            break
        equal = s[a[left] + d] == s[b[left] + d]
        same[left[~equal]] = False
        left = left[equal]
        d += 1
        left = left[lengths[left] > d]
    return same


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Places of s, whose values are below symbols, in order of the suffixes that begin there."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    types = s_types(s)
    lms = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    starts = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
    ends = np.flatnonzero(s[1:] != s[:-1])
    longest = int(np.diff(ends, prepend=-1, append=n - 1).max())  # a run of one symbol takes as many waves
    by = induce if n > WAVE * symbols and longest <= WAVE else induce_singly
    if len(lms) > 1:
        sa = by(s, types, lms, starts)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        # each substring runs to the next leftmost-smaller place, the last one to the end
        length = np.zeros(n, np.int64)
        length[lms] = np.diff(np.append(lms, n)) + 1
        length[lms[-1]] -= 1
        a, b = ordered[:-1], ordered[1:]
        equal = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
        some = np.flatnonzero(equal)
        equal[some] = _same(s, a[some], b[some], length[a[some]])
        name = np.empty(n, np.int64)
        name[ordered] = np.concatenate(([0], np.cumsum(~equal)))
        names = name[lms]
        top = int(names.max()) + 1
        lms = lms[np.argsort(names) if top == len(lms) else suffix_array(names, top)]
    return by(s, types, lms, starts)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of s, the length that its suffix has in common with the one before it in sa.

    Only irreducible ones are compared, that is where the symbols before the two suffixes differ: all others are one less than the
    one of the place before.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    fresh = (before <= 0) | (place == 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = s[rest - 1] != s[before[rest] - 1]
    out = np.zeros(n, np.int64)
    left = np.flatnonzero(fresh & (before >= 0))
    d = np.zeros(len(left), np.int64)
    # eight symbols at a time where they are bytes
    wide = np.lib.stride_tricks.sliding_window_view(s, 8).view(np.uint64)[:, 0] if s.dtype == np.uint8 and n >= 8 and s.flags.c_contiguous else None
    if wide is not None:
        going = np.arange(len(left))
        while len(going):
            a, b = left[going] + d[going], before[left[going]] + d[going]
            going, a, b = (x[(a < len(wide)) & (b < len(wide))] for x in (going, a, b))
            going = going[wide[a] == wide[b]]
            d[going] += 8
    going = np.arange(len(left))
    while len(going):
        a, b = left[going] + d[going], before[left[going]] + d[going]
        going, a, b = (x[(a < n) & (b < n)] for x in (going, a, b))
        going = going[s[a] == s[b]]
        d[going] += 1
    out[left] = d
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    return np.where(before >= 0, np.maximum(out[last] - (place - last), 0), 0)


def doubled(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, another way against which tests hold the first."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    new = np.concatenate(([True], s[sa][1:] != s[sa][:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 1
    while True:
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return sa
        i = sa[open_]
        second = np.where(i + width < n, rank[np.minimum(i + width, n - 1)] + 1, 0)
        first = rank[i]
        order = np.lexsort((second, first))
        i, first, second = i[order], first[order], second[order]
        sa[open_] = i
        fresh = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        new[open_] = fresh
        rank[i] = np.maximum.accumulate(np.where(fresh, open_, 0))
        width *= 2
