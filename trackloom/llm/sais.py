"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than their right neighbour; the
leftmost smaller ones (LMS) are sorted through the names of their substrings,
recursively, and all others follow from them in two passes over the buckets. For
the few symbols of the first level a pass handles the entries of a bucket
together, in a few array operations for each symbol. Below it there are many
names and most buckets are short, so the same pass goes entry by entry.
"""

from __future__ import annotations

import numpy as np

FEW_SYMBOLS = 1024  # up to which a pass goes bucket by bucket


def classify(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one to its right; the last, a unique least symbol, counts as smaller."""
    n = len(s)
    smaller = np.empty(n, dtype=bool)
    smaller[-1] = True
    if n > 1:
        change = s[1:] != s[:-1]
        up = s[1:] > s[:-1]
        # equal neighbours take the type of the next change
        at = np.where(change, np.arange(n - 1), n)
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        smaller[:-1] = up[np.minimum(nearest, n - 2)]
    return smaller


def _append(sa, ptr, symbols, entries, step):
    """Put entries into their buckets in the order given, forwards (step 1) or from the bucket's end (step -1)."""
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    count = np.bincount(symbols, minlength=len(ptr))
    starts = np.cumsum(count) - count
    within = np.arange(len(symbols)) - starts[sorted_symbols]
    sa[ptr[sorted_symbols] + step * within] = entries[order]
    ptr += step * count


def _induce(s, smaller, sa_lms, bucket_start, bucket_end, alphabet):
    """The order of all suffixes from a sequence of LMS positions."""
    by_bucket = alphabet <= FEW_SYMBOLS
    return (_induce_buckets if by_bucket else _induce_entries)(s, smaller, sa_lms, bucket_start, bucket_end, alphabet)


def _induce_entries(s, smaller, sa_lms, bucket_start, bucket_end, alphabet):
    """``_induce`` entry by entry: larger suffixes from the left, smaller ones from the right."""
    symbols, is_smaller, sa = s.tolist(), smaller.tolist(), [0] * len(s)
    back = bucket_end.tolist()
    for p in reversed(sa_lms.tolist()):
        c = symbols[p]
        back[c] -= 1
        sa[back[c]] = p
    front = bucket_start.tolist()
    for i in range(len(sa)):
        p = sa[i] - 1
        if p >= 0 and not is_smaller[p]:
            c = symbols[p]
            sa[front[c]] = p
            front[c] += 1
    back = bucket_end.tolist()
    for i in range(len(sa) - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and is_smaller[p]:
            c = symbols[p]
            back[c] -= 1
            sa[back[c]] = p
    sa[0] = len(s) - 1
    return np.array(sa, dtype=np.int32)


def _induce_buckets(s, smaller, sa_lms, bucket_start, bucket_end, alphabet):
    """``_induce`` bucket by bucket."""
    sa = np.full(len(s), -1, dtype=np.int32)
    symbols = s[sa_lms]
    order = np.argsort(symbols, kind="stable")  # LMS at the ends of their buckets
    lms_sorted = sa_lms[order]
    lms_count = np.bincount(symbols, minlength=alphabet)
    lms_start = np.cumsum(lms_count) - lms_count
    front = bucket_start.copy()
    for c in range(alphabet):
        done = bucket_start[c]
        while done < front[c]:
            todo = sa[done : front[c]]
            done = front[c]
            before = todo[todo > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _append(sa, front, s[before], before, 1)
        if lms_count[c]:
            before = lms_sorted[lms_start[c] : lms_start[c] + lms_count[c]]
            before = before[before > 0] - 1
            _append(sa, front, s[before], before, 1)
    back = bucket_end - 1
    larger_end = front  # the larger part of bucket c is sa[bucket_start[c]:front[c]]
    for c in range(alphabet - 1, -1, -1):
        done = bucket_end[c] - 1
        while done > back[c]:
            todo = sa[back[c] + 1 : done + 1][::-1]
            done = back[c]
            before = todo[todo > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _append(sa, back, s[before], before, -1)
        todo = sa[bucket_start[c] : larger_end[c]][::-1]
        before = todo[todo > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _append(sa, back, s[before], before, -1)
    sa[0] = len(s) - 1
    return sa


def _repeats(s: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each substring equals the one before it in the list, symbol by symbol."""
    equal = np.zeros(len(starts), dtype=bool)
    open_ = np.flatnonzero(lengths[1:] == lengths[:-1]) + 1
    done = 0
    while len(open_) > 16:
        open_ = open_[s[starts[open_] + done] == s[starts[open_ - 1] + done]]
        done += 1
        ended = lengths[open_] == done
        equal[open_[ended]] = True
        open_ = open_[~ended]
    for i in open_:  # few, maybe long ones
        x, y, n = starts[i], starts[i - 1], lengths[i]
        equal[i] = np.array_equal(s[x + done : x + n], s[y + done : y + n])
    return equal


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of ``s``, whose last symbol is 0 and occurs nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = classify(s)
    count = np.bincount(s, minlength=alphabet)
    bucket_end = np.cumsum(count)
    bucket_start = bucket_end - count
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    rough = _induce(s, smaller, lms, bucket_start, bucket_end, alphabet)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    # names: LMS substrings up to and with the next LMS position, equal ones share a name
    lengths = np.zeros(n, dtype=np.int64)
    lengths[lms] = np.append(lms[1:] + 1, n) - lms
    name_of = np.cumsum(~_repeats(s, ordered, lengths[ordered])) - 1
    names = np.empty(n, dtype=np.int64)
    names[ordered] = name_of
    reduced = names[lms]
    kinds = int(name_of[-1]) + 1
    if kinds == len(lms):
        lms_order = np.empty(len(lms), dtype=np.int64)
        lms_order[reduced] = np.arange(len(lms))
    else:
        lms_order = suffix_array(reduced, kinds)
    return _induce(s, smaller, lms[lms_order], bucket_start, bucket_end, alphabet)


def common_prefixes(data: np.ndarray, sa: np.ndarray, limit: int, fresh: np.ndarray) -> np.ndarray:
    """For each position the common prefix with the suffix before it in order, in text order (PLCP), up to ``limit``.

    Where the byte before both suffixes is the same, the value is one less than
    that of the position before; the others are compared eight bytes at a time.
    fresh: positions to compare in any case (starts of separate texts).
    """
    n = len(data)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    before = np.concatenate([[0], data[:-1]])
    plain = (phi > 0) & (before == before[np.maximum(phi, 0)])
    plain[0] = False
    plain[fresh] = False
    own = np.flatnonzero(~plain & (phi >= 0))
    padded = np.concatenate([data.astype(np.uint8), np.zeros(limit + 8, np.uint8)])
    word = np.zeros(n + limit, dtype=np.uint64)
    for j in range(8):
        word |= padded[j : j + n + limit].astype(np.uint64) << np.uint64(8 * j)
    length = np.zeros(n, dtype=np.int64)
    x, y, at, done = own, phi[own], own, 0
    while len(x) and done < limit:
        differ = word[x + done] ^ word[y + done]
        end = differ != 0
        if end.any():
            d = differ[end]
            low = d & (~d + np.uint64(1))
            length[at[end]] = done + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        go = ~end
        x, y, at = x[go], y[go], at[go]
        done += 8
    length[at] = limit
    value = np.where(plain, 0, length + np.arange(n))
    return np.minimum(np.maximum(np.maximum.accumulate(value) - np.arange(n), 0), limit)
