"""Deep-shallow sorting of suffixes up to a length, in one task's memory.

As in multikey quicksort, groups that agree so far are split by their next key; a key is eight bytes, all
groups of a depth are split together, and the split is numpy's sort by (group, key), down to a shallow depth: no pivots
are chosen, and the order is the same.  What then still agrees has a long common prefix: such groups are ordered by blind tries, which compare one byte at each branch and
the whole string only once per insertion.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def words_at(data: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as a number that orders like them; zero from ``ends`` on.

    ``data`` has eight bytes from the last place on.
    """
    rows = np.lib.stride_tricks.sliding_window_view(data, WORD)[places]
    out = rows.view(">u8").ravel().astype(np.uint64)
    inside = np.clip(ends - places, 0, WORD)
    if len(inside) and inside.min() < WORD:
        out &= _MASKS[inside]
    return out


# What is kept of a word of which so many bytes lie within the suffix.
_MASKS = np.array([((1 << 8 * k) - 1) << 8 * (WORD - k) for k in range(WORD + 1)], np.uint64)


class BlindTrie:
    """A Patricia trie over strings of one length; equal strings share a leaf."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    def insert(self, string: bytes, item: int) -> None:
        if self.root is None:
            self.root = (string, [item])
            return
        node, path = self.root, []
        while type(node) is list:  # a branch: [depth, {byte: child}]
            path.append(node)
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other, items = node
        if other == string:
            items.append(item)
            return
        depth = next(k for k, (a, b) in enumerate(zip(string, other, strict=True)) if a != b)
        leaf, above = (string, [item]), None
        for branch in path:
            if branch[0] == depth:
                branch[1][string[depth]] = leaf
                return
            if branch[0] > depth:
                break
            above = branch
        below = self.root if above is None else above[1][string[above[0]]]
        new = [depth, {other[depth]: below, string[depth]: leaf}]
        if above is None:
            self.root = new
        else:
            above[1][string[above[0]]] = new

    def leaves(self):
        """Lists of equal strings' items, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack += [node[1][byte] for byte in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def deep_shallow(data: np.ndarray, starts: np.ndarray, limit: int, shallow: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by their first ``limit`` bytes, and the class of each place in it.

    Suffixes of one class agree in ``limit`` bytes.  ``data`` ends with ``limit`` spare bytes.
    """
    order = np.arange(len(starts))
    ranks = np.zeros(len(starts), np.int64)  # by place in ``order``: where its group begins
    depth, active = 0, np.arange(len(starts))  # places whose group has several members
    while depth < min(shallow, limit) and len(active):
        items = order[active]
        places = starts[items] + depth
        keys = words_at(data, places, starts[items] + limit)
        by = np.lexsort((keys, ranks[active]))
        order[active] = items[by]
        keys = keys[by]
        new = np.ones(len(active), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ranks[active][1:] != ranks[active][:-1])
        heads = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
        ranks[active] = active[heads]
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        depth += WORD
    if depth < limit and len(active):
        _deepen(data, starts, order, ranks, active, depth, limit)
    return order, ranks


def _deepen(data, starts, order, ranks, active, depth, limit) -> None:
    """Order each remaining group by a blind trie; what equals its first member is set aside before."""
    items, body = order[active], data.tobytes()
    heads = np.flatnonzero(np.append(True, ranks[active][1:] != ranks[active][:-1]))
    sizes = np.diff(np.append(heads, len(active)))
    first = np.repeat(items[heads], sizes)
    same = np.ones(len(active), bool)
    for at in range(depth, limit, WORD):
        one, two = starts[items] + at, starts[first] + at
        same &= words_at(data, one, starts[items] + limit) == words_at(data, two, starts[first] + limit)
    mixed = ~np.logical_and.reduceat(same, heads)
    for head, size in zip(heads[mixed].tolist(), sizes[mixed].tolist(), strict=True):
        group, equal = items[head : head + size], same[head : head + size]
        trie = BlindTrie()
        for item in [-1, *group[~equal].tolist()]:
            begin = starts[group[0] if item < 0 else item]
            trie.insert(body[begin + depth : begin + limit], item)
        at = active[head]
        for leaf in trie.leaves():
            members = group[equal].tolist() + leaf[1:] if leaf[0] == -1 else leaf
            order[at : at + len(members)] = members
            ranks[at : at + len(members)] = at
            at += len(members)
