"""Suffix arrays by induced sorting, with whole buckets moved at a time, and common prefixes carried along in text order."""

from __future__ import annotations

import numpy as np

#: A reduced string of more symbols is written with two digits a symbol, so that inducing walks over few buckets at every level.
WIDEST = 2048


def s_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the empty suffix, smallest of all, stands at the end."""
    n = len(s)
    sign = np.empty(n, np.int8)
    sign[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    sign[-1] = -1
    at = np.where(sign != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ decides a run
    return np.r_[sign[at] > 0, True]


def _deal(chars: np.ndarray, values: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends values to the buckets of their characters, in order."""
    if len(values) == 0:
        return
    order = chars.argsort(kind="stable")  # by radix: symbols have 16 bits
    chars, values = chars[order], values[order]
    cuts = (chars[1:] != chars[:-1]).nonzero()[0] + 1
    lo = 0
    for hi in (*cuts.tolist(), len(chars)):
        into[int(chars[lo])].append(values[lo:hi])
        lo = hi


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes that an order of the leftmost smaller ones gives: larger ones forward, then smaller ones backward."""
    n = len(s)
    none = np.zeros(0, np.int64)
    joined = lambda parts: np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else none
    stars: list[list[np.ndarray]] = [[] for _ in range(k)]
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(s[lms], lms, stars)
    larger[int(s[n - 1])].append(np.array([n - 1]))

    def spread(of: np.ndarray, want: bool, into: list[list[np.ndarray]]) -> None:
        before = of[of > 0] - 1
        before = before[is_s[before] == want]
        _deal(s[before], before, into)

    for c in range(k):
        own, done = larger[c], []
        while own:  # what a bucket adds to itself is read in turn
            part = joined(own)
            own.clear()
            done.append(part)
            spread(part, False, larger)
        larger[c] = [joined(done)]
        spread(joined(stars[c]), False, larger)
    for c in range(k - 1, -1, -1):
        own, done = smaller[c], []  # held last suffix first
        while own:
            part = joined(own)
            own.clear()
            done.append(part)
            spread(part, True, smaller)
        smaller[c] = [joined(done)]
        spread(larger[c][0][::-1], True, smaller)
    return np.concatenate([p for c in range(k) for p in (larger[c][0], smaller[c][0][::-1])])


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Starts of the suffixes of s (symbols 0 to k - 1) in order; a suffix that is a prefix of another comes first."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    if k > WIDEST:  # two digits a symbol: suffixes that begin with a symbol keep their order
        base = int(np.ceil(np.sqrt(k)))
        order = suffix_array(np.stack([s // base, s % base], 1).ravel(), base)
        return order[order % 2 == 0] // 2
    s = s.astype(np.uint16)
    is_s = s_types(s)
    lms = np.flatnonzero(is_s[1:n] & ~is_s[: n - 1]) + 1
    if not len(lms):
        return _induce(s, is_s, lms, k)
    order = _induce(s, is_s, lms, k)
    flag = np.zeros(n + 1, bool)
    flag[lms] = True
    order = order[flag[order]]  # by leftmost smaller substring
    end = np.full(n + 1, n)
    end[lms[:-1]] = lms[1:]
    name = np.zeros(len(order), bool)
    a, b = order[:-1], order[1:]
    length = np.minimum(end[a], n) - a + 1
    same = (end[a] - a == end[b] - b) & (end[a] < n) & (end[b] < n)
    at = np.flatnonzero(same)
    for t in range(int(length[at].max()) if len(at) else 0):
        at = at[length[at] > t]
        differs = s[a[at] + t] != s[b[at] + t]
        same[at[differs]] = False
        at = at[~differs]
        if not len(at):
            break
    name[1:] = ~same
    names = np.cumsum(name)
    if names[-1] + 1 == len(lms):
        return _induce(s, is_s, order, k)
    reduced = np.empty(n + 1, np.int64)
    reduced[order] = names
    reduced = reduced[lms]
    inner = suffix_array(reduced, int(names[-1]) + 1)
    return _induce(s, is_s, lms[inner], k)


def permuted_prefixes(s: np.ndarray, order: np.ndarray, cap: int | None = None, stop: int | None = None) -> np.ndarray:
    """For each suffix in text order, its common prefix with the suffix before it in the array, at most cap.

    Symbols are compared only where a suffix and its neighbour have unlike symbols before them; from there the prefix is
    carried on, one shorter with each step. If given, the symbol `stop` equals nothing, and prefixes end before it.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    j = before[1:]
    go_on = np.r_[False, (j > 0) & (before[:-1] >= 0) & (s[j - 1] == s[:-1])]
    if stop is not None:
        go_on[1:] &= s[:-1] != stop
    # Ends, and stops, are unlike whatever they meet: the two sides have different words there.
    ours, theirs = (np.r_[s.astype(np.uint64), np.full(4, v, np.uint64)] for v in (0xFFFE, 0xFFFF))
    if stop is not None:
        ours[:n][s == stop], theirs[:n][s == stop] = 0xFFFC, 0xFFFD
    ours, theirs = (w[:-3] | w[1:-2] << np.uint64(16) | w[2:-1] << np.uint64(32) | w[3:] << np.uint64(48) for w in (ours, theirs))
    common = np.zeros(n, np.int64)
    live = np.flatnonzero(~go_on & (before >= 0))
    while len(live):
        i, j = live + common[live], before[live] + common[live]
        apart = ours[i] ^ theirs[j]
        equal = apart == 0
        last = live[~equal]
        low = apart[~equal]
        common[last] += (low & np.uint64(0xFFFF) == 0).astype(np.int64) + (low & np.uint64(0xFFFFFFFF) == 0) + (low & np.uint64(0xFFFFFFFFFFFF) == 0)
        live = live[equal]
        common[live] += 4
    since = np.maximum.accumulate(np.where(go_on, 0, at))
    common = np.maximum(common[since] - (at - since), 0)
    return common if cap is None else np.minimum(common, cap)
