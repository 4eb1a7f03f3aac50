"""A prefix tree of ordered sets, and the similarity search that walks it.

Sets are sorted lists of ints. Paths without branches are one node (a slice of the list that
made it), so the tree has at most two nodes for each set. A search walks the tree once for
all sets below a node, sharing the mismatches counted so far, and leaves out a subtree when

* no set below can be similar by its length, or
* the mismatches so far, plus those that the remaining lengths force, are too many, or
* everything below is known to be in the searching set's component already.
"""

from __future__ import annotations


class Components:
    """Union-find over row numbers; ``links`` is what was joined (a spanning forest)."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


class Node:
    __slots__ = ("path", "start", "end", "children", "members", "low", "high", "label")

    def __init__(self, path, start, end, size):
        self.path, self.start, self.end = path, start, end
        self.children: dict[int, Node] = {}
        self.members: list[int] = []
        self.low = self.high = size   # sizes of the sets below
        self.label = None             # a member's row if all below are in one component


class Trie:
    def __init__(self, percent: int, parts: Components):
        self.percent, self.parts = percent, parts
        self.root = Node([], 0, 0, 0)
        self.root.low, self.root.high = 1 << 60, 0

    def insert(self, s: list[int], row: int) -> None:
        node, at, n = self.root, 0, len(s)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if node.label is not None and self.parts.find(node.label) != self.parts.find(row):
                node.label = None
            if at == n:
                node.members.append(row)
                return
            child = node.children.get(s[at])
            if child is None:
                child = node.children[s[at]] = Node(s, at, n, n)
                child.members.append(row)
                child.label = row
                return
            i, k = at, child.start
            while k < child.end and i < n and child.path[k] == s[i]:
                i, k = i + 1, k + 1
            if k < child.end:  # the new set leaves inside the child's path: split it
                top = Node(child.path, child.start, k, 0)
                top.low, top.high, top.label = child.low, child.high, child.label
                child.start = k
                top.children[child.path[k]] = child
                node.children[s[at]] = child = top
            node, at = child, i

    def search(self, s: list[int], row: int) -> None:
        """Join ``row`` with every set that is similar to ``s``, except where a chain of
        earlier joins already connects the two."""
        n, keep, lose, parts = len(s), self.percent, 100 - self.percent, self.parts
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, wrong = stack.pop()
            high, low = node.high, node.low
            if 100 * high < keep * n or 100 * n < keep * low:
                continue
            if node.label is not None and parts.find(node.label) == parts.find(row):
                continue
            limit = lose * (n + high) // (100 + keep)  # symmetric difference of similar sets
            path, k, end = node.path, node.start, node.end
            while k < end and wrong <= limit:
                t = path[k]
                while at < n and s[at] < t:
                    at, wrong = at + 1, wrong + 1
                if at < n and s[at] == t:
                    at += 1
                else:
                    wrong += 1
                k += 1
            forced = max(0, (n - at) - (high - end), (low - end) - (n - at))
            if wrong + forced > limit:
                continue
            if node.members:
                both = (n + end - (wrong + n - at)) // 2
                if 100 * both >= keep * (n + end - both):
                    for m in node.members:
                        parts.join(m, row)
            following = s[at] if at < n else None
            for t, child in node.children.items():
                if t != following:
                    stack.append((child, at, wrong))
            if following in node.children:
                stack.append((node.children[following], at, wrong))
            self._relabel(node)

    def _relabel(self, node: Node) -> None:
        """Label a node when all that it has directly below carries one component."""
        if node.label is None and node is not self.root:
            rows = list(node.members)
            for child in node.children.values():
                if child.label is None:
                    return
                rows.append(child.label)
            if rows and len({self.parts.find(r) for r in rows}) == 1:
                node.label = rows[0]


def similar_within(sets: list[list[int]], percent: int) -> list[tuple[int, int]]:
    """Links that connect all similar sets of one list."""
    parts = Components(len(sets))
    tree = Trie(percent, parts)
    for i, s in enumerate(sets):
        tree.search(s, i)
        tree.insert(s, i)
    return parts.links


def similar_between(first: list[list[int]], second: list[list[int]], percent: int) -> list[tuple[int, int]]:
    """Links between the sets of two lists (rows of the second follow those of the first)."""
    parts = Components(len(first) + len(second))
    tree = Trie(percent, parts)
    for i, s in enumerate(first):
        tree.insert(s, i)
    for j, s in enumerate(second):
        tree.search(s, len(first) + j)
    return parts.links
