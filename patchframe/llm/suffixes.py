"""Suffix arrays by linear grouping.

First phase: suffixes start in groups by their first symbol.  Groups are taken in
descending order.  Each suffix of a group finds the nearest smaller suffix to its left
(a pointer jump over suffixes of higher groups); that suffix's prefix grows by the
group's, and it moves to a new group just above its old one.  In the end a suffix's
group is its longest Lyndon prefix.  Second phase: in ascending order, every suffix
that is placed places the larger suffixes that end before it, each at the front of its
group.  Nothing is renamed and there is no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in ascending order.

    ``text`` holds whole numbers; 0 ends a string, smaller than any symbol, and of two
    0s the earlier is smaller.  The last number must be 0.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(text, kind="stable")
    symbols, first = np.unique(text[order], return_index=True)
    ends = int(np.count_nonzero(text == 0))
    names = np.searchsorted(symbols, text)
    group = names.tolist()  # group of each suffix; group 0: string ends
    members = [p.tolist() for p in np.split(order, first[1:])]
    k = len(members)
    below = list(range(-1, k - 1))  # neighbours in the order of groups
    above = list(range(1, k)) + [-1]
    prev = [0] * n  # nearest smaller suffix to the left; at -1 a string end stands for it
    high = [False] * n  # in a group already taken, or in the one at hand
    now = k - 1
    while now > 0:
        own = members[now]
        if now >= k:
            members[now] = None
        if len(own) == 1:
            i = own[0]
            if group[i] == now:
                j = i - 1
                while j >= 0 and high[j]:
                    j = prev[j]
                prev[i] = j
                high[i] = True
                if j >= 0 and group[j]:
                    old = group[j]
                    new = len(members)
                    up = above[old]
                    members.append([j])
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
                    group[j] = new
            now = below[now]
            continue
        times: dict = {}
        for i in own:
            if group[i] == now:
                high[i] = True
                j = i - 1
                while j >= 0 and high[j]:
                    j = prev[j]
                prev[i] = j
                if j >= 0 and group[j]:
                    times[j] = times.get(j, 0) + 1
        if times:
            # A prefix that the group's follows more often is larger: it goes above.
            if len(times) == 1 or max(times.values()) == 1:
                rounds = [times]
            else:
                by: dict = {}
                for j, c in times.items():
                    by.setdefault(c, []).append(j)
                rounds = [by[c] for c in sorted(by, reverse=True)]
            for some in rounds:
                made: dict = {}
                for j in some:
                    old = group[j]
                    new = made.get(old)
                    if new is None:
                        new = made[old] = len(members)
                        up = above[old]
                        members.append([j])
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        below[up] = new
                    else:
                        members[new].append(j)
                    group[j] = new
        now = below[now]
    # Front of each group in the order of groups.
    size = np.bincount(np.array(group), minlength=len(members)).tolist()
    front = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        front[g] = at
        at += size[g]
        g = above[g]
    out = [0] * n
    out[:ends] = np.flatnonzero(text == 0).tolist()
    placed = [False] * n
    for i in out[:ends]:
        placed[i] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = prev[j]
    return np.array(out)
