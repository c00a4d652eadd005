"""Suffix array by linear grouping (no recursion, no renaming), after Baier, "Linear-time suffix sorting" (CPM 2016).

Phase 1 puts suffixes into groups by their Lyndon prefix.  Groups are taken in descending order.  For every suffix
of the group at hand the nearest earlier suffix of a lower group (previous-smaller pointer) is found; such a
suffix's own prefix is followed by the group's prefix, once or several times, so it moves to a new group right
above its old one, the further up the more often.  Phase 2 emits the order: going through the array upward, each
suffix places the one before it, and that one's chain of pointers, at the front of its group.

A group's members are taken by position; the built-in sort puts them in that order, which costs a logarithm in theory and the
least time in practice.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions in the order of the suffixes; symbols are any non-negative integers."""
    n = len(text)
    if n == 0:
        return []
    # Groups are stretches of the array: a group is named by its first place, `size` by that name.
    by_symbol: list[list[int]] = [[] for _ in range(max(text) + 1)]
    for i, c in enumerate(text):
        by_symbol[c].append(i)
    order = [i for group in by_symbol for i in group]
    place = [0] * n  # of each suffix in the array
    group = [0] * n  # of each suffix
    size = [0] * n
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1
    prev = [-2] * n  # -2: not known yet
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end]
        end = g
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if not times:
            continue
        if len(times) == 1:
            levels = [list(times)]
        else:
            most = max(times.values())
            if most == 1:
                levels = [list(times)]
            else:
                by: list[list[int]] = [[] for _ in range(most + 1)]
                for j, t in times.items():
                    by[t].append(j)
                levels = [x for x in reversed(by) if x]
        for level in levels:
            # Move the level's suffixes to the back of their groups, ...
            moved: dict[int, int] = {}
            for j in level:
                h = group[j]
                left = size[h] - 1
                size[h] = left
                last, at = h + left, place[j]
                if at != last:
                    other = order[last]
                    order[at], place[other] = other, at
                    order[last], place[j] = j, last
                moved[h] = moved.get(h, 0) + 1
            # ... where they are a group of their own.
            for j in level:
                h = group[j]
                group[j] = h + size[h]
            for h, m in moved.items():
                size[h + size[h]] = m
    # Phase 2. An end-of-text symbol, less than all, comes first.
    sa = [-1] * n
    front = list(range(n))
    done = [False] * n

    def put(i: int) -> None:
        while i >= 0 and not done[i]:
            g = group[i]
            sa[front[g]] = i
            front[g] += 1
            done[i] = True
            i = prev[i]

    put(n - 1)
    for k in range(n):
        put(sa[k] - 1)
    return sa


def lcp_array(text: Sequence[int], sa: list[int]) -> list[int]:
    """lcp[k]: common prefix of the suffixes at k - 1 and k in the order (Kasai et al.)."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(sa):
        rank[i] = k
    lcp, h = [0] * n, 0
    for i in range(n):
        k = rank[i]
        if k == 0:
            h = 0
            continue
        j = sa[k - 1]
        top = n - max(i, j)
        while h < top and text[i + h] == text[j + h]:
            h += 1
        lcp[k] = h
        if h:
            h -= 1
    return lcp
