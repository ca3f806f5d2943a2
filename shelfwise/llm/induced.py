"""Suffix array by induced sorting, and permuted common prefixes.

``suffix_array`` is SA-IS: classify suffixes as L or S, sort the
leftmost-smaller (LMS) substrings by induction, name them, order the reduced
string where names repeat, and induce the order of all suffixes from that of
the LMS suffixes. The buckets are scanned as whole arrays; a bucket's own L or
S chain needs one wave per run length.

Texts are integers >= 1; the end of the text is the smallest suffix.
"""

from __future__ import annotations

import numpy as np

from shelfwise.llm import common



def _kind(n: int):
    """Integers for positions in a text of n characters."""
    return np.int32 if n < 2 ** 31 - 16 else np.int64


def classify(t: np.ndarray) -> np.ndarray:
    """True for S type: smaller than the suffix after it. The last suffix is L."""
    n = len(t)
    less, more = t[:-1] < t[1:], t[:-1] > t[1:]
    decided = np.append(less | more, True)
    kind = np.append(less, False)
    nxt = np.where(decided, np.arange(n, dtype=_kind(n)), n).astype(_kind(n))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    return kind[nxt]


def lms_positions(s: np.ndarray) -> np.ndarray:
    return (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(_kind(len(s)))


def _scan(t, s, seeds: dict[int, np.ndarray], alphabet: range, want: bool, first: np.ndarray | None) -> dict[int, list[np.ndarray]]:
    """Induce one type over array buckets, in the order of ``alphabet``.

    ``seeds``: per character the suffixes of the other type, in scan order.
    Returns per character the induced suffixes in scan order. ``want`` is the
    type (S True) that is induced.
    """
    out: dict[int, list[np.ndarray]] = {}
    if first is not None and len(first):
        out[int(t[first[0]])] = [first]

    def induce(items: np.ndarray, c: int) -> np.ndarray:
        p = items[items > 0] - 1
        p = p[s[p] == want]
        if not len(p):
            return p
        ch = t[p]
        order = np.argsort(ch, kind="stable")
        p, ch = p[order], ch[order]
        cut = np.flatnonzero(ch[1:] != ch[:-1]) + 1
        own = p[:0]
        for part in np.split(p, cut):
            x = int(t[part[0]])
            if x == c:
                own = part
            else:
                out.setdefault(x, []).append(part)
        return own

    for c in alphabet:
        lists = out.get(c)
        if lists:
            wave = np.concatenate(lists) if len(lists) > 1 else lists[0]
            done = []
            while len(wave):
                done.append(wave)
                wave = induce(wave, c)
            out[c] = done
        if c in seeds:  # of the other type: what they induce lies in later buckets
            induce(seeds[c], c)
    return out


def _by_character(t: np.ndarray, items: np.ndarray) -> dict[int, np.ndarray]:
    """Split items, ordered by character, into their buckets."""
    if not len(items):
        return {}
    ch = t[items]
    return {int(t[p[0]]): p for p in np.split(items, np.flatnonzero(ch[1:] != ch[:-1]) + 1)}


def _induce_arrays(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all suffixes in order; S suffixes in order) from LMS suffixes in bucket order."""
    last = np.asarray([len(t) - 1], lms.dtype)  # induced by the end of the text
    ls = _scan(t, s, _by_character(t, lms), range(1, k), False, last)
    l_sorted = {c: np.concatenate(p) for c, p in ls.items()}
    ss = _scan(t, s, {c: p[::-1] for c, p in l_sorted.items()}, range(k - 1, 0, -1), True, None)
    s_sorted = {c: np.concatenate(p)[::-1] for c, p in ss.items()}
    empty = np.empty(0, lms.dtype)
    parts = [x for c in range(1, k) for x in (l_sorted.get(c, empty), s_sorted.get(c, empty))]
    return np.concatenate(parts), np.concatenate([empty, *(s_sorted[c] for c in sorted(s_sorted))])


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of the reduced string. Ranks of 1, 2, 4, ... names are
    doubled, and only suffixes that still share a rank are sorted again.
    (Element-wise recursion takes several times as long in Python.)"""
    n, h = len(names), 1
    order = np.argsort(names, kind="stable")
    new = np.concatenate([[True], np.diff(names[order]) != 0])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    rank[n] = 0  # the end
    size = np.diff(np.append(np.flatnonzero(new), n))
    open_ = order[np.repeat(size > 1, size)]
    while len(open_):
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + h, n)]
        place = np.argsort(key, kind="stable")
        open_, key = open_[place], key[place]
        head = rank[open_]
        group = np.concatenate([[True], head[1:] != head[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(open_))
        base = np.maximum.accumulate(np.where(group, at, 0))
        run = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = head + run - base
        size = np.diff(np.append(np.flatnonzero(new), len(open_)))
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank[:n] - 1] = np.arange(n)
    return out


def suffix_array(t: np.ndarray, k: int | None = None) -> np.ndarray:
    t, n = np.asarray(t), len(t)
    if n < 2:
        return np.arange(n)
    k = k or int(t.max()) + 1
    s = classify(t)
    lms = lms_positions(s)
    if not len(lms):
        return _induce_arrays(t, s, lms, k)[0]
    # Sort the LMS substrings: induce from LMS positions ordered by first character only.
    by_char = lms[np.argsort(t[lms], kind="stable")]
    _, s_order = _induce_arrays(t, s, by_char, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = s_order[is_lms[s_order]]
    # Equal neighbours get one name: same length, characters and types.
    rank = np.empty(n, _kind(n))
    rank[lms] = np.arange(len(lms))
    end = np.append(lms[1:], n - 1)
    length = end[rank[order]] - order + 1
    differs = np.ones(len(order), bool)
    same = np.flatnonzero((length[1:] == length[:-1]) & (end[rank[order[1:]]] != n - 1) & (end[rank[order[:-1]]] != n - 1))
    if len(same):
        size = length[same]
        a, b = common.ranges(order[same], size), common.ranges(order[same + 1], size)
        bad = (t[a] != t[b]) | (s[a] != s[b])
        first = np.cumsum(size) - size
        differs[same + 1] = np.logical_or.reduceat(bad, first)
    names = np.empty(n, _kind(n))
    names[order] = np.cumsum(differs)
    reduced = names[lms]
    m = int(differs.sum())
    if m < len(lms):
        order = lms[_order_of_names(reduced)]
    return _induce_arrays(t, s, order, k)[0]


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix (cut at ``most``) of each suffix, in text order, with the
    suffix before it in the array. Only irreducible values are compared; along
    a reducible run the value falls by one per position."""
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    phi = np.full(n, -1, _kind(n))
    phi[sa[1:]] = sa[:-1]
    pos = np.arange(n, dtype=_kind(n))
    reducible = (phi > 0) & (pos > 0)
    at = np.flatnonzero(reducible)
    chain = (phi[at - 1] == phi[at] - 1) & (t[at - 1] == t[phi[at] - 1])
    reducible[at] = chain
    start = np.flatnonzero(~reducible & (phi >= 0))
    # Eight bytes at a time, then the rest; zeros behind the end never match two ends.
    padded = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1)).copy().view("<u8").reshape(-1)
    value = np.zeros(n, np.int64)
    # The chain may shorten a value by its length, so it is compared that much further.
    run = np.diff(np.append(np.flatnonzero(~reducible), n))
    reach = np.minimum(run[np.searchsorted(np.flatnonzero(~reducible), start)] + most, n)
    live, got = np.arange(len(start)), np.zeros(len(start), np.int64)
    while len(live):
        a, b = start[live] + got[live], phi[start[live]] + got[live]
        inside = (a < n) & (b < n) & (got[live] < reach[live])
        equal = np.zeros(len(live), bool)
        x = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        equal[inside] = x[inside] == 0
        full = inside & equal & (a + 8 <= n) & (b + 8 <= n)
        part = inside & ~full
        if part.any():
            y, room = x[part], np.minimum(n - a[part], n - b[part])
            zero = np.zeros(len(y), np.int64)
            open_ = np.ones(len(y), bool)
            for i in range(8):
                open_ &= ((y >> np.uint64(8 * i)) & np.uint64(255)) == 0
                zero += open_
            got[live[part]] += np.minimum(zero, room)
        got[live[full]] += 8
        live = live[full]
    value[start] = got + start
    anchor = np.maximum.accumulate(np.where(reducible, -1, pos))
    out = value[anchor] - pos
    out[phi < 0] = 0
    return np.minimum(np.maximum(out, 0), most)
