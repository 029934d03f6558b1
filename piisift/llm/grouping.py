"""Suffix arrays by linear grouping on Lyndon prefixes."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The suffix array of integers whose last is smaller than all others.

    First all suffixes are grouped by their Lyndon prefix.  A suffix starts in
    the group of its first symbol; groups are taken in descending order.  A
    member points to the nearest suffix before it that is smaller (in a lower
    group), jumping over what is settled already.  That suffix is followed by
    the member's Lyndon prefix, so it moves up into a new group just above its
    own, the higher the more members in a row point to it.  Then the order
    inside the groups is emitted from the smallest suffix on: a suffix that is
    known puts those whose Lyndon prefix ends where it begins at the next
    places of their groups.  Nothing is renamed or sorted again.
    """
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    symbols = sorted(first)
    rank = {c: g for g, c in enumerate(symbols)}
    group_of = [rank[c] for c in text]
    groups = [first[c] for c in symbols]
    below = [g - 1 for g in range(len(groups))]
    above = [g + 1 for g in range(len(groups))]
    settled, jump, smaller, falling = bytearray(n), [-1] * n, [-1] * n, []

    def rise(under: int, risen: list[int]) -> int:
        """A new group just above ``under``; the old lists keep their former members, told by `group_of`."""
        new, upper = len(groups), above[under]
        groups.append(risen)
        below.append(under)
        above.append(upper)
        below[upper] = above[under] = new
        for p in risen:
            group_of[p] = new
        return new

    current = len(groups) - 1
    while current >= 0:
        groups[current] = members = [i for i in groups[current] if group_of[i] == current]
        falling.append(current)
        if len(members) == 1:  # its own case only to be quick: one member, at most one suffix that rises
            i = p = members[0]
            p -= 1
            while p >= 0 and settled[p]:
                p = jump[p]
            jump[i] = smaller[i] = p
            settled[i] = 1
            if p >= 0:
                rise(group_of[p], [p])
            current = below[current]
            continue
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and settled[p]:
                p = jump[p]
            jump[i] = p
            if p >= 0 and group_of[p] == current:
                p = smaller[p]  # members in a row lead to the same suffix
            smaller[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        for i in members:
            settled[i] = 1
        rising: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            rising.setdefault(group_of[p], {}).setdefault(k, []).append(p)
        for old, by_times in rising.items():
            last = old
            for k in sorted(by_times):
                last = rise(last, sorted(by_times[k]))
        current = below[current]
    start, at = [0] * len(groups), n
    for g in falling:
        at -= len(groups[g])
        start[g] = at
    order = [0] * n
    order[0] = n - 1
    for r in range(n):
        stop, j = smaller[order[r]], order[r] - 1
        while j != stop:
            g = group_of[j]
            order[start[g]] = j
            start[g] += 1
            j = smaller[j]
    return order


def common_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """Length of the common prefix of each suffix with the one before it in the order (0 for the first), by text position."""
    n = len(text)
    before = [-1] * n
    for a, b in zip(order, order[1:], strict=False):
        before[b] = a
    out, k = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            k = 0
            continue
        while i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        out[i] = k
        if k:
            k -= 1
    return out
