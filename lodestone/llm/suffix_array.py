"""Suffix arrays by linear grouping: Lyndon groups from high to low, then their order."""

from __future__ import annotations


UNKNOWN = -2


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the start of its Lyndon group in the order, and the previous smaller suffix.

    At first a group holds the suffixes of one symbol. Groups are taken from the highest
    down. Of each member of a taken group, the nearest suffix before it that lies in a
    lower group continues with this group's prefix; those that so many members point to
    move to a new group just above their own. What is left in a taken group shares its
    longest Lyndon prefix.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place = [0] * n
    start = [0] * n
    size = [0] * (n + 1)
    first = 0
    for k, i in enumerate(order):
        if k and s[i] != s[order[k - 1]]:
            first = k
        place[i], start[i] = k, first
        size[first] += 1
    smaller = [UNKNOWN] * n
    end = n - 1
    while end >= 0:
        low = start[order[end]]
        pointed: dict[int, int] = {}
        for i in order[low : end + 1]:
            j = smaller[i]
            if j == UNKNOWN:
                # members of this group on the way are passed by, and have the same one
                passed = [i]
                j = i - 1
                while j >= 0 and start[j] >= low:
                    back = smaller[j]
                    if back == UNKNOWN:
                        passed.append(j)
                        back = j - 1
                    j = back
                for k in passed:
                    smaller[k] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, count in pointed.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            moved = by_count[count]
            for j in moved:  # to the end of its group
                g = start[j]
                size[g] -= 1
                last = g + size[g]
                other, at = order[last], place[j]
                order[at], order[last] = other, j
                place[other], place[j] = at, last
            fresh = [start[j] + size[start[j]] for j in moved]
            for j, g in zip(moved, fresh, strict=True):
                start[j] = g
            for g in fresh:
                size[g] += 1
        end = low - 1
    return start, smaller


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of s in order; the last symbol must be the only least one.

    The order inside the groups follows from the left: the suffix before the next one in
    order, and the chain of previous smaller suffixes from there, take the next free
    places of their groups, until one is placed already.
    """
    n = len(s)
    if n < 2:
        return list(range(n))
    free, smaller = lyndon_groups(s)
    group = list(free)
    free = list(range(n + 1))
    out = [-1] * n
    placed = bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    free[group[n - 1]] += 1
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out
