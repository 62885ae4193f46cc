"""Suffix arrays by linear grouping (Baier, "Linear-time Suffix Sorting", CPM 2016), and the repeated windows of a set of short strings.

`suffix_array` groups suffixes by Lyndon prefixes. Phase one takes groups in descending
order: each suffix of a group is a Lyndon word that follows its previous smaller suffix,
so those predecessors are split, by how many such words follow them, into new groups
just above what is left of their old ones. Phase two emits the order: from the least
suffix on, the suffix before each emitted one takes the next place of its group, and so
do its previous smaller ones until one has its place. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np

#: Strings are cut into symbols after a space or line feed, unless a symbol would be longer than this; then every byte is a symbol.
LONGEST_SYMBOL = 64


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order. The last symbol must be the least and unique; symbols are 0 to n."""
    n = len(text)
    if n < 2:
        return list(range(n))
    order = np.argsort(np.asarray(text), kind="stable")
    row = order.tolist()
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    place = where.tolist()
    inorder = np.asarray(text)[order]
    first = np.flatnonzero(np.concatenate(([True], inorder[1:] != inorder[:-1])))
    sizes = np.diff(np.concatenate((first, [n])))
    size = [0] * n
    for a, b in zip(first.tolist(), sizes.tolist(), strict=True):
        size[a] = b
    of = np.empty(n, np.int64)
    of[order] = np.repeat(first, sizes)
    group = of.tolist()  # a group is known by the first place that it takes
    smaller = [-1] * n
    top = n
    while top:
        low = group[row[top - 1]]
        if top - low == 1:
            s = row[low]
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0 and size[g := group[p]] > 1:
                end = g + size[g] - 1
                other, at = row[end], place[p]
                row[end], row[at], place[p], place[other] = p, other, end, at
                size[g] -= 1
                size[end] = 1
                group[p] = end
            top = low
            continue
        times: dict[int, int] = {}
        for s in sorted(row[low:top]):
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by: dict[int, list[int]] = {}
        for p, k in times.items():
            by.setdefault(k, []).append(p)
        for k in sorted(by, reverse=True):
            moved: dict[int, int] = {}
            for p in by[k]:
                g = group[p]
                m = moved.get(g, 0)
                end = g + size[g] - 1 - m
                other, at = row[end], place[p]
                row[end], row[at], place[p], place[other] = p, other, end, at
                moved[g] = m + 1
            for p in by[k]:
                g = group[p]
                group[p] = g + size[g] - moved[g]
            for g, m in moved.items():
                if m < size[g]:
                    size[g] -= m
                    size[g + size[g]] = m
        top = low
    out, done = [0] * n, [False] * n
    free = list(range(n))  # by group: the next place in it
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = smaller[s]
    return out


def _symbols(strings: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings joined (with slack), starts and ends of the strings, and starts of symbols in the joined bytes."""
    joined = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    starts = np.concatenate(([0], ends[:-1]))
    cut = np.zeros(len(joined) + 1, bool)
    cut[1:] = (joined == 32) | (joined == 10)
    cut[starts] = True
    at = np.flatnonzero(cut[:-1])
    if len(at) and np.diff(np.concatenate((at, [len(joined)]))).max() > longest:
        at = np.arange(len(joined))
    return joined, starts, ends, at


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, the starts of its windows of `length` bytes that start somewhere else as well, in it or another.

    The suffix array is built over symbols (words with the space that ends them: a cut depends on
    the byte before it alone, so equal bytes are cut alike and no symbol is another's prefix).
    A window that starts inside a symbol is found from the first cut in it: the suffixes there
    agree for the rest of the window, and the bytes before the cut are equal too.
    """
    strings = list(strings)
    empty = np.zeros(0, np.int64)
    if not any(strings):
        return [empty for _ in strings]
    joined, starts, ends, at = _symbols(strings, min(LONGEST_SYMBOL, length // 2))
    size = np.diff(np.concatenate((at, [len(joined)])))
    raw = joined.tobytes()
    if (size == 1).all():
        numbers = joined.astype(np.int64) + 2
    else:
        words = [raw[a:b] for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
        number = {w: k + 2 for k, w in enumerate(sorted(set(words)))}
        numbers = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    # A separator (1) after each string, the sentinel (0) after all.
    string = np.searchsorted(ends, at, "right")
    slot = np.arange(len(at)) + string
    text = np.ones(len(at) + len(strings) + 1, np.int64)
    text[slot] = numbers
    text[-1] = 0
    back = np.full(len(text), -1)
    back[slot] = np.arange(len(at))
    # Symbols 0 to n: number them densely.
    rows = back[np.array(suffix_array(np.unique(text, return_inverse=True)[1].tolist()))]
    rows = rows[rows >= 0]
    position, limit = at[rows], ends[string[rows]]
    agree = _agreements(joined, position, limit, length)
    before = np.where(at[rows] == starts[string[rows]], 0, at[rows] - at[np.maximum(rows - 1, 0)])
    found = []
    left = np.zeros(len(rows), np.uint64)
    active = np.arange(len(rows))
    for a in range(int(before.max(initial=0)) + 1):
        if a:
            active = active[before[active] >= a]
            if not len(active):
                break
            left[active] = left[active] * np.uint64(1_000_003) + joined[position[active] - a] + np.uint64(1)
        joinable = agree >= length - a
        near = np.concatenate((joinable, [False])) | np.concatenate(([False], joinable))
        own = active[near[active]]
        if len(own) < 2:
            continue
        run = np.cumsum(np.concatenate(([0], ~joinable)))[own].astype(np.uint64)
        key = (run * np.uint64(0x9E3779B97F4A7C15)) ^ (left[own] * np.uint64(0xD6E8FEB86659FD93))
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        found.append(position[own[by[many]]] - a)
    hits = np.unique(np.concatenate(found)) if found else empty
    owner = np.searchsorted(ends, hits, "right")
    cuts = np.searchsorted(owner, np.arange(len(strings) + 1))
    return [hits[cuts[k] : cuts[k + 1]] - starts[k] for k in range(len(strings))]


def _agreements(joined: np.ndarray, position: np.ndarray, limit: np.ndarray, length: int) -> np.ndarray:
    """Bytes, `length` at most, in which each suffix agrees with the next in order, inside their strings."""
    padded = np.concatenate((joined, np.zeros(length, np.uint8)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, length)
    out = np.empty(max(0, len(position) - 1), np.int64)
    for k in range(0, len(out), 4096):
        a, b = windows[position[k : k + 4096]][: len(out) - k], windows[position[k + 1 : k + 4097]]
        differ = a[: len(b)] != b
        out[k : k + len(b)] = np.where(differ.any(1), differ.argmax(1), length)
    room = limit - position
    return np.minimum(out, np.minimum(room[:-1], room[1:]))
