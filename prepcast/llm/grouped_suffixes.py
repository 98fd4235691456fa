"""Suffix array by grouping suffixes on their Lyndon prefixes.

Phase 1 takes groups of suffixes (at first: equal first symbols) in descending
order. When a group is taken, every member points to the nearest suffix before it
that lies in a smaller group (its previous smaller pointer, found by following
earlier pointers). The suffixes pointed at are longer by the group's prefix, once
for each member pointing there, and move behind the rest of their own group, most
repeats last. When all groups are taken, each holds the suffixes of one Lyndon
prefix, in order.

Phase 2 goes through the order from the front. The suffix before the current one,
and those on its pointer chain that have no place yet, are followed by the current
suffix after their Lyndon prefix; each takes the next free place of its group.
No text is renamed or sorted again.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of ``text``, which must end with its only smallest symbol."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group = [0] * n, [0] * n
    last: dict[int, int] = {}
    at = 0
    for k, i in enumerate(order):
        if k and text[order[k - 1]] != text[i]:
            at = k
        place[i], group[i] = k, at
        last[at] = k
    before = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        hits: dict[int, int] = {}
        for i in sorted(order[start:end + 1]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, k in hits.items():
            by_count.setdefault(k, {}).setdefault(group[j], []).append(j)
        for k in sorted(by_count, reverse=True):
            for g, moved in by_count[k].items():
                top = back = last[g]
                for j in moved:  # to the back of their group
                    p, other = place[j], order[back]
                    order[p], order[back] = other, j
                    place[other], place[j] = p, back
                    back -= 1
                last[g] = back
                for j in moved:
                    group[j] = back + 1
                last[back + 1] = top
        end = start - 1
    out, placed = [-1] * n, [False] * n
    next_free: dict[int, int] = {}
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            spot = next_free.get(g, g)
            out[spot], placed[j] = j, True
            next_free[g] = spot + 1
            j = before[j]
    return out
