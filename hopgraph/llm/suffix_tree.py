"""Suffix trees of sequences of small numbers, for longest common extensions in constant time."""

from __future__ import annotations

import numpy as np


def ukkonen(seq: list[int], symbols: int) -> tuple[dict[int, int], list[int], list[int]]:
    """The suffix tree of ``seq`` (numbers from 1 to symbols - 1) and a terminal 0, built from left to right.

    Returns the edges (node * symbols + first symbol -> child) and the start and end of every node's edge label.
    The end of a leaf is the end of the sequence; leaves are made in the order of their suffixes.
    """
    s = [*seq, 0]
    size = len(s)
    edges: dict[int, int] = {}
    start, end, link = [0], [0], [0]
    node = edge = length = waiting = 0
    for i, c in enumerate(s):
        last = 0
        waiting += 1
        while waiting:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                end.append(size)
                link.append(0)
                if last:
                    link[last] = node
                last = node
            else:
                begin = start[child]
                span = end[child] - begin
                if length >= span:
                    node, edge, length = child, edge + span, length - span
                    continue
                if s[begin + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                edges[key] = split
                start += (begin, i)
                end += (begin + length, size)
                link += (0, 0)
                edges[split * symbols + c] = split + 1
                start[child] = begin + length
                edges[split * symbols + s[begin + length]] = child
                if last:
                    link[last] = split
                last = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return edges, start, end


def tour(parents: np.ndarray, children: np.ndarray, start: list[int], end: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Euler tour of a tree whose edges are given in order: leaves (suffixes) as met, and the depth of the shallowest node between two."""
    first = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
    children = children.tolist()
    depth, order, between = [0] * len(start), [], []
    stack, above, after_leaf = [0], [0] * len(start), False
    while stack:
        v = stack.pop()
        if after_leaf:
            # After a leaf the tour climbs to the nearest node with a child left; its depth is the common prefix.
            between.append(depth[above[v]])
            after_leaf = False
        if v:
            depth[v] = depth[above[v]] + end[v] - start[v]
        a, b = first[v], first[v + 1]
        if a == b:
            order.append(size - depth[v])
            after_leaf = True
        for k in range(b - 1, a - 1, -1):
            child = children[k]
            above[child] = v
            stack.append(child)
    return np.array(order, np.int32), np.array(between, np.int32)


class Extensions:
    """Longest common extensions of the suffixes of a sequence: the depth of the lowest common ancestor of two leaves.

    The tour's depths between leaves go into a sparse table of minima, so a query takes two look-ups.
    """

    def __init__(self, seq: list[int], symbols: int, both_orders: bool = False):
        edges, start, end = ukkonen(seq, symbols)
        size = len(seq) + 1
        keys, children = np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
        del edges
        parents, first = keys // symbols, keys % symbols
        by = np.argsort(keys)
        order, between = tour(parents[by], children[by], start, end, size)
        self.rank = np.empty(size, np.int32)
        self.rank[order] = np.arange(size, dtype=np.int32)
        #: Ranks where symbols are compared the other way round and the end still comes first.
        self.other_rank = None
        if both_orders:
            by = np.lexsort((np.where(first == 0, 0, symbols - first), parents))
            order, _ = tour(parents[by], children[by], start, end, size)
            self.other_rank = np.empty(size, np.int32)
            self.other_rank[order] = np.arange(size, dtype=np.int32)
        self.table = [between]
        while 2 << (len(self.table) - 1) <= len(between):
            top, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(top[:-step], top[step:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes i and j, which differ from each other."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int32)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][a[at]], self.table[k][b[at] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every suffix but the last, the next suffix that is smaller: where its longest Lyndon word ends."""
    r = rank.tolist()
    out = [len(r)] * len(r)
    for i in range(len(r) - 2, -1, -1):
        k = i + 1
        while r[k] > r[i]:
            k = out[k]
        out[i] = k
    return np.array(out[:-1], np.int32)
