"""Suffix arrays by linear grouping.

Suffixes are grouped by the Lyndon words that they start with. Groups are taken in descending order; each suffix of the group
points to the nearest suffix before it in a lower group, and what is pointed at moves to a new group just above its own, those
with more pointers higher. When all groups are done, one pass emits the order: each placed suffix places the one before it
and then that one's chain of pointers, each at the front of its group.
"""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Order of the suffixes of s, whose last symbol is its smallest and occurs once. Symbols are small integers from 0."""
    n = len(s)
    count = [0] * (max(s) + 2)
    for c in s:
        count[c + 1] += 1
    for c in range(1, len(count)):
        count[c] += count[c - 1]
    group = [count[c] for c in s]  # a group is named by the start of its interval of slots
    fill, slots, slot_of, size = count[:], [0] * n, [0] * n, [0] * n
    for i, c in enumerate(s):
        k = fill[c]
        fill[c] = k + 1
        slots[k], slot_of[i] = i, k
        size[count[c]] += 1
    before = [-1] * n

    end = n
    while end:
        start = group[slots[end - 1]]
        if end - start == 1:
            i = slots[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0 and size[g := group[j]] > 1:
                size[g] -= 1
                top, k = g + size[g], slot_of[j]
                other = slots[top]
                slots[k], slot_of[other], slots[top], slot_of[j] = other, k, j, top
                group[j], size[top] = top, 1
            end = start
            continue
        members, open_ = slots[start:end], {}
        for i in members:  # up to the first suffix that isn't in a higher group
            j = i - 1
            while j >= 0 and group[j] >= end:
                j = before[j]
            open_[i] = j
        pointers: dict[int, int] = {}
        for i in members:  # chains within the group end where their last one points to
            chain, j = [], i
            while j in open_:
                chain.append(j)
                j = open_.pop(j)
            if j >= 0 and group[j] == start:
                j = before[j]
            for c in chain:
                before[c] = j
            if j >= 0 and chain:
                pointers[j] = pointers.get(j, 0) + len(chain)
        subsets: list[dict[int, list[int]]] = [{} for _ in range(1 + max(pointers.values(), default=0))]
        for j, times in pointers.items():
            subsets[times].setdefault(group[j], []).append(j)
        for of_times in reversed(subsets):
            for g, moving in of_times.items():
                if len(moving) == size[g]:
                    continue  # the whole group goes up: nothing changes
                top = g + size[g]
                for j in moving:
                    top -= 1
                    k, other = slot_of[j], slots[top]
                    slots[k], slot_of[other], slots[top], slot_of[j] = other, k, j, top
                for j in moving:
                    group[j] = top
                size[g] -= len(moving)
                size[top] = len(moving)
        end = start

    order, front, placed = [n - 1] + [-1] * (n - 1), list(range(n)), [False] * n
    placed[n - 1] = True
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = before[j]
    return order
