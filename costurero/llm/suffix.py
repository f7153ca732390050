"""Suffix arrays by induced sorting, and permuted common prefixes.

A suffix is of type S if it is smaller than the one behind it, else of type L; the leftmost of a run of S suffixes
starts a leftmost-smaller (LMS) substring. LMS substrings are named in their order, the string of names is sorted
unless all differ, and the order of all suffixes is induced from it in two scans over the buckets of first symbols. A
text of few symbols takes each bucket as one array; a string of many names is sorted by doubling the ranked length.
"""

from __future__ import annotations

import numpy as np

FEW = 1024


def types_of(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is a sentinel, smaller than all others."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    # Equal neighbours have the type of the next position that differs.
    place = np.where(step != 0, np.arange(n - 1), n)
    place = np.minimum.accumulate(place[::-1])[::-1]
    s = np.ones(n, bool)
    s[:-1] = step[np.minimum(place, n - 2)] > 0
    return s


def names_of(text: np.ndarray, s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each LMS substring among all (equal ones share it) and the number of different ones.

    Symbols carry their type, so that no substring is a beginning of another. They are compared several at a time;
    later symbols only where the earlier ones are equal.
    """
    symbols = text.astype(np.uint64) * np.uint64(2) + s + np.uint64(1)
    bits = int(symbols.max()).bit_length()
    per = 63 // bits
    length = np.diff(np.concatenate([lms, [lms[-1]]])) + 1
    symbols = np.concatenate([symbols, np.zeros(per, np.uint64)])

    def chunk(which: np.ndarray, c: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for k in range(c * per, (c + 1) * per):
            inside = k < length[which]
            at = np.minimum(lms[which] + k, len(symbols) - 1)
            out = out << np.uint64(bits) | np.where(inside, symbols[at], np.uint64(0))
        return out

    rank = np.zeros(len(lms), np.int64)
    which, c = np.arange(len(lms)), 0
    while len(which):
        keys = chunk(which, c)
        order = np.lexsort((keys, rank[which]))
        r, k = rank[which][order], keys[order]
        at = np.arange(len(r))
        group = np.concatenate([[True], r[1:] != r[:-1]])
        new = group | np.concatenate([[True], k[1:] != k[:-1]])
        base = np.maximum.accumulate(np.where(group, at, 0))
        rank[which[order]] = r + np.maximum.accumulate(np.where(new, at, 0)) - base
        c += 1
        longer = length[which] > c * per
        tied = np.zeros(len(lms) + 1, np.int64)
        np.add.at(tied, rank[which], 1)
        open_ = np.zeros(len(lms) + 1, bool)
        open_[rank[which][longer]] = True
        which = which[open_[rank[which]] & (tied[rank[which]] > 1)]
    used = np.zeros(len(lms), np.int64)
    used[rank] = 1
    dense = np.cumsum(used) - 1
    return dense[rank], int(used.sum())


def deal(queues: list[list[np.ndarray]], items: np.ndarray, symbols: np.ndarray) -> None:
    """Append items to the queues of their symbols, in order."""
    order = np.argsort(symbols, kind="stable")
    items, symbols = items[order], symbols[order]
    start = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if len(items) else []
    for a, b in zip(start, [*start[1:], len(items)]):
        queues[symbols[a]].append(items[a:b])


def induce_by_bucket(text: np.ndarray, s: np.ndarray, lms_sorted: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes from that of the LMS suffixes, a bucket of the first symbol at a time."""
    first = text[lms_sorted]
    cuts = np.searchsorted(first, np.arange(size + 1))
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]  # L suffixes by symbol, ascending
    for c in range(size):
        done = 0
        parts = smaller[c]
        while done < len(parts):
            items, done = (parts[done] if len(parts) - done == 1 else np.concatenate(parts[done:])), len(parts)
            before = items[items > 0] - 1
            before = before[~s[before]]
            deal(smaller, before, text[before])
        items = lms_sorted[cuts[c] : cuts[c + 1]]
        before = items[items > 0] - 1
        deal(smaller, before, text[before])
    ascending = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in smaller]
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]  # S suffixes by symbol, descending
    for c in reversed(range(size)):
        done = 0
        parts = larger[c]
        while done < len(parts):
            items, done = (parts[done] if len(parts) - done == 1 else np.concatenate(parts[done:])), len(parts)
            before = items[items > 0] - 1
            before = before[s[before]]
            deal(larger, before, text[before])
        items = ascending[c][::-1]
        before = items[items > 0] - 1
        before = before[s[before]]
        deal(larger, before, text[before])
    larger[0] = [np.array([len(text) - 1])]
    out = []
    for c in range(size):
        out.append(ascending[c])
        out.extend(p[::-1] for p in reversed(larger[c]))
    return np.concatenate(out)


def sort_by_doubling(text: np.ndarray) -> np.ndarray:
    """Suffix array for a large alphabet: ranks by 1, 2, 4, ... first symbols, each from two ranks of half as many.

    A suffix whose rank is its own is in place. The others go on; none of them reaches the end, as the last symbol is
    the only one of its kind.
    """
    order = np.argsort(text, kind="stable")
    rank, open_, ahead = np.zeros(len(text), np.int64), np.arange(len(text)), 1
    keys = text[order]
    while len(open_):
        # `open_` are places in the order, a group of equal ranks after the other; `keys` tell the groups' parts.
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([start, [len(open_)]]))
        at = order[open_]
        rank[at] = np.repeat(open_[start], size)
        tied = np.repeat(size > 1, size)
        open_, at = open_[tied], at[tied]
        keys = rank[at] * len(text) + rank[np.minimum(at + ahead, len(text) - 1)]
        by = np.argsort(keys)
        order[open_], keys = at[by], keys[by]
        ahead *= 2
    return order


def sort_suffixes(text: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of numbers below `size`; the last is the only zero."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    if size > FEW:
        return sort_by_doubling(text)
    s = types_of(text)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    names, different = names_of(text, s, lms)
    if different == len(lms):
        order = np.argsort(names)
    else:
        order = sort_suffixes(names, different)
    return induce_by_bucket(text, s, lms[order], size)


def suffix_array(data: bytes) -> np.ndarray:
    """Suffix array of bytes."""
    text = np.zeros(len(data) + 1, np.int16)
    text[:-1] = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    return sort_suffixes(text, 257)[1:]


def common_prefixes(data: bytes, order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each position, the length of the prefix its suffix shares with the suffix before it in order.

    `room` is how far a position may look (to the end of its piece of the text); shared prefixes end there. Going
    from a position to the next, the length falls by one unless the symbols before the two suffixes differ; only
    there, and where a piece starts, it is counted, eight bytes at a time.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    text = np.frombuffer(data, np.uint8)
    start = np.concatenate([[True], room[1:] != room[:-1] - 1])
    left = np.where(before > 0, text[np.maximum(before, 1) - 1], 0)
    counted = start | (before <= 0) | (np.concatenate([[0], text[:-1]]) != left)
    at = np.flatnonzero(counted)
    padded = data + bytes(16)
    eight = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    length = np.zeros(len(at), np.int64)
    active = np.flatnonzero((before[at] >= 0) & (room[at] > 0))
    while len(active):
        i, j = at[active] + length[active], before[at[active]] + length[active]
        differ = eight[i] ^ eight[np.minimum(j, n)]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & -differ) - np.uint64(1)).astype(np.int64) // 8)
        length[active] = np.minimum(length[active] + same, np.minimum(room[at[active]], n - before[at[active]]))
        active = active[(same == 8) & (length[active] < np.minimum(room[at[active]], n - before[at[active]]))]
    value = np.zeros(n, np.int64)
    value[at] = length
    last = np.maximum.accumulate(np.where(counted, np.arange(n), 0))
    return np.maximum(np.minimum(value[last] - (np.arange(n) - last), room), 0)
