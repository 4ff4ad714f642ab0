"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are classified as larger (L) or smaller (S) than their successor. The leftmost S
suffixes (LMS) are sorted by their substrings, named, and the string of names is sorted by
recursion; the order of all suffixes is then induced bucket by bucket, every bucket's
entries placing their predecessors at once. Time is linear in the text for a bounded number
of buckets: names of the recursion are spelt with two digits where there are many, so that
no level has more than some thousand buckets.
"""

from __future__ import annotations

import numpy as np

DIGITS = 1024  # names beyond so many are spelt with two digits


def smaller_type(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the end is smaller than all)."""
    n = len(t)
    up = np.zeros(n, bool)
    up[:-1] = t[1:] > t[:-1]
    change = np.ones(n, bool)
    change[:-1] = t[1:] != t[:-1]
    at = np.flatnonzero(change)
    return np.repeat(up[at], np.diff(np.r_[-1, at]))  # equal letters are as the first change after them


class _Buckets:
    def __init__(self, t: np.ndarray, size: int):
        self.count = np.bincount(t, minlength=size)
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count


def induce(t: np.ndarray, small: np.ndarray, buckets: _Buckets, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes induced from an order of the LMS suffixes."""
    n, size = len(t), len(buckets.count)
    out = np.full(n, -1, np.int32)
    head, letters = buckets.start.copy(), np.flatnonzero(buckets.count).tolist()
    steps = np.arange(n, dtype=np.int64)
    # has an entry a predecessor that is L, or one that is S?
    before_l, before_s = np.zeros(n, bool), np.zeros(n, bool)
    before_s[1:] = small[:-1]
    before_l[1:] = ~small[:-1]
    lms_letter = t[lms]
    lms_by = lms[np.argsort(lms_letter, kind="stable")]
    lms_count = np.bincount(lms_letter, minlength=size)
    lms_end = np.cumsum(lms_count)
    lms_start = lms_end - lms_count

    def forward(entries: np.ndarray) -> None:
        """Put entries, in order, into their buckets from the front."""
        c = t[entries]
        by = c.argsort(kind="stable")
        c = c[by]
        counts = np.bincount(c, minlength=size)
        base = head - np.cumsum(counts)
        base += counts
        out[base[c] + steps[: len(c)]] = entries[by]
        np.add(head, counts, out=head)

    def backward(entries: np.ndarray) -> None:
        """The same from the back."""
        c = t[entries]
        by = c.argsort(kind="stable")
        c = c[by]
        counts = np.bincount(c, minlength=size)
        base = tail + np.cumsum(counts)
        base -= counts + 1
        out[base[c] - steps[: len(c)]] = entries[by]
        np.subtract(tail, counts, out=tail)

    forward(np.array([n - 1], np.int32))  # the end comes first and its predecessor is L
    for c in letters:
        done = buckets.start[c]
        while done < (stop := head[c]):  # entries of this bucket may add to it
            now = out[done:stop]
            done = stop
            now = now[before_l[now]]
            if len(now):
                forward(now - 1)
        if lms_count[c]:
            own = lms_by[lms_start[c] : lms_end[c]]
            own = own[own > 0] - 1
            if len(own):
                forward(own)
    tail = buckets.end.copy()
    for c in reversed(letters):
        done = buckets.end[c]
        while done > (stop := tail[c]):
            now = out[stop:done][::-1]
            done = stop
            now = now[before_s[now]]
            if len(now):
                backward(now - 1)
        now = out[buckets.start[c] : head[c]][::-1]
        now = now[before_s[now]]
        if len(now):
            backward(now - 1)
    return out


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings given their order; equal substrings share a rank."""
    rank_of = np.empty(len(t), np.int32)
    rank_of[lms] = np.arange(len(lms))
    which = rank_of[order]  # place of each in the text's order of LMS
    stop = np.r_[lms[1:], len(t) - 1]
    length = (stop - lms + 1)[which]
    a, b = order[:-1], order[1:]
    last = which == len(lms) - 1  # it runs to the end: equal to no other
    same = (length[:-1] == length[1:]) & ~last[:-1] & ~last[1:]
    open_, k = np.flatnonzero(same), 0
    while len(open_):
        open_ = open_[length[open_] > k]
        differs = t[a[open_] + k] != t[b[open_] + k]
        same[open_[differs]] = False
        open_ = open_[~differs]
        k += 1
    names = np.empty(len(lms), np.int64)
    names[which] = np.r_[0, np.cumsum(~same)]
    return names


def suffix_array(t: np.ndarray, size: int | None = None, depth: int | None = None, spans: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of ``t`` (numbers from 0 to ``size`` - 1) in order.

    With ``depth`` the order need only be right for so many letters: the recursion ends once
    all equal names stand for that many (``spans``: letters of the text that an element of a
    deeper level stands for).
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    size = size or int(t.max()) + 1
    # 16-bit letters are placed by radix sort
    t = np.ascontiguousarray(t, np.uint16 if size <= 1 << 16 else np.int64)
    buckets = _Buckets(t, size)
    small = smaller_type(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) < 2:
        return induce(t, small, buckets, lms)
    first = induce(t, small, buckets, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    names = _names(t, lms, first[is_lms[first]])
    many = int(names.max()) + 1
    reach = np.arange(n + 1) if spans is None else np.concatenate([[0], np.cumsum(spans)])
    covers = np.diff(np.append(reach[lms], reach[n]))
    if many == len(lms) or (depth is not None and covers[np.bincount(names)[names] > 1].min() >= depth):
        by = np.argsort(names, kind="stable")
    elif many <= DIGITS:
        by = suffix_array(names, many, depth, covers)
    else:
        base = int(np.ceil(np.sqrt(many)))
        spelt, spans = np.empty(2 * len(names), np.int64), np.zeros(2 * len(names), np.int64)
        spelt[0::2], spelt[1::2] = names // base, names % base
        spans[1::2] = covers  # a name counts once its second digit agrees
        by = suffix_array(spelt, base, depth, spans)
        by = by[by % 2 == 0] // 2
    return induce(t, small, buckets, lms[by])


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each start the bytes it shares with the suffix before it
    in the order, up to ``most`` (eight bytes a step; pairs that differ drop out)."""
    n = len(data)
    padded = np.zeros(n + most + 16, np.uint8)
    padded[:n] = data
    eight = np.zeros(n + most + 8, np.uint64)
    for k in range(8):
        eight |= padded[k : k + len(eight)].astype(np.uint64) << np.uint64(8 * k)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    plcp = np.zeros(n, np.int64)
    open_, k = np.flatnonzero(before >= 0), 0
    while len(open_) and k < most:
        x = eight[open_ + k] ^ eight[before[open_] + k]
        equal = x == 0
        ends = open_[~equal]
        low = x[~equal]
        low &= ~low + np.uint64(1)  # its lowest set bit
        plcp[ends] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        open_ = open_[equal]
        k += 8
    plcp[open_] = most
    return np.minimum(np.minimum(plcp, most), n - np.maximum(np.arange(n), before))
