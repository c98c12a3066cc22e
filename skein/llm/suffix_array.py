"""Suffix arrays by induced sorting (Nong, Zhang and Chan, 2009) and permuted common prefixes (Kaerkkaeinen, Manzini and Puglisi, 2009)."""

from __future__ import annotations

import numpy as np


def _smaller_than_next(s: np.ndarray) -> np.ndarray:
    """True at suffixes of type S: smaller than the suffix that starts one later. The last is of type L."""
    n = len(s)
    step = np.sign(s[1:] - s[:-1])
    # equal neighbours take the type of the next change to the right
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    change = np.minimum.accumulate(at[::-1])[::-1]
    types = np.zeros(n, bool)
    known = change < n - 1
    types[:-1][known] = step[change[known]] > 0
    return types


def _induce(s: list[int], is_s: list[bool], heads: np.ndarray, tails: np.ndarray, sorted_lms: list[int]) -> list[int]:
    """All suffixes in order, from the leftmost-smaller ones in order."""
    n = len(s)
    order = [-1] * n
    end = tails.tolist()
    for p in reversed(sorted_lms):
        c = s[p]
        end[c] -= 1
        order[end[c]] = p
    front = heads.tolist()
    c = s[n - 1]  # the last suffix, which the end of the text induces, is the first of its bucket's type L
    order[front[c]] = n - 1
    front[c] += 1
    for i in range(n):
        p = order[i] - 1
        if p >= 0 and not is_s[p]:
            c = s[p]
            order[front[c]] = p
            front[c] += 1
    end = tails.tolist()
    for i in range(n - 1, -1, -1):
        p = order[i] - 1
        if p >= 0 and is_s[p]:
            c = s[p]
            end[c] -= 1
            order[end[c]] = p
    return order


def suffix_array(text: np.ndarray) -> list[int]:
    """Starts of all suffixes of an array of integers from 0 on, in lexicographic order."""
    n = len(text)
    if n < 2:
        return list(range(n))
    text = np.asarray(text, np.int64)
    types = _smaller_than_next(text)
    lms = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    counts = np.bincount(text)
    tails = np.cumsum(counts)
    heads = tails - counts
    s, is_s = text.tolist(), types.tolist()
    rough = np.array(_induce(s, is_s, heads, tails, lms.tolist()))
    if len(lms) > 1:
        # names of the substrings between leftmost-smaller positions, both included, in their order
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        in_order = rough[is_lms[rough]]
        rank_of = np.full(n, -1)
        rank_of[lms] = np.arange(len(lms))
        ends = np.r_[lms[1:], n - 1]  # the last one goes to the text's end
        length = (ends - lms + 1)[rank_of[in_order]]
        last = rank_of[in_order] == len(lms) - 1
        same = (length[1:] == length[:-1]) & ~last[1:] & ~last[:-1]
        pairs = np.flatnonzero(same)
        k = 0
        while len(pairs):  # compares all pairs at once, a position at a time
            a, b = in_order[pairs] + k, in_order[pairs + 1] + k
            alike = (text[a] == text[b]) & (types[a] == types[b])
            same[pairs[~alike]] = False
            k += 1
            pairs = pairs[alike]
            pairs = pairs[length[pairs] > k]
        names = np.r_[0, np.cumsum(~same)]
        reduced = np.empty(len(lms), np.int64)
        reduced[rank_of[in_order]] = names
        if names[-1] + 1 < len(lms):
            lms = lms[np.array(suffix_array(reduced))]
        else:
            lms = lms[np.argsort(reduced)]
        return _induce(s, is_s, heads, tails, lms.tolist())
    return rough.tolist()


def permuted_lcp(text: np.ndarray, order: list[int]) -> np.ndarray:
    """At each position, the length of its suffix's common prefix with the suffix before it in order (0 at the first)."""
    n = len(text)
    s = text.tolist()
    before = [-1] * n
    previous = -1
    for p in order:
        before[p] = previous
        previous = p
    out = [0] * n
    length = 0
    for i in range(n):
        j = before[i]
        if j < 0:
            length = 0
            continue
        a, b = i + length, j + length
        stop = n - (i if i > j else j)
        while length + 32 <= stop and s[a : a + 32] == s[b : b + 32]:
            length += 32
            a += 32
            b += 32
        while length < stop and s[a] == s[b]:
            length += 1
            a += 1
            b += 1
        out[i] = length
        if length:
            length -= 1
    return np.array(out, np.int64)
