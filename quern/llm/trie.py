"""A prefix tree of ordered sets, joined with a batch of probes.

Sets are sequences of token ranks in one order, frequent tokens first, so that alike sets
share long prefixes. Nodes of the tree are runs of tokens (a radix tree). The traversal
carries, for all probes at once, the overlap with the path so far, which everything below
a node shares; a probe leaves a subtree as soon as its overlap so far and what can still
come, by the tokens left in the probe and below, fall short of what the sizes ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Cells of the table of tokens by probes that one traversal holds.
CELLS = 1 << 24


class Node:
    __slots__ = ("children", "depth", "longest", "parent_depth", "sets", "smallest", "source")

    def __init__(self, source: int, depth: int):
        self.source, self.depth, self.parent_depth = source, depth, 0
        self.children: list[Node] = []
        self.sets: list[int] = []
        self.smallest = self.longest = 0


def ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set as rising ranks: tokens that more sets hold first, those of one set alone left out."""
    if not sets:
        return [], 0
    sizes = np.array([len(s) for s in sets])
    tokens, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.full(len(tokens), -1, np.int64)
    shared = np.flatnonzero(count > 1)
    rank[shared[np.argsort(-count[shared], kind="stable")]] = np.arange(len(shared))
    out = []
    for part in np.split(rank[inverse], np.cumsum(sizes)[:-1]):
        part = part[part >= 0]
        part.sort()
        out.append(part)
    return out, len(shared)


def build(seqs: list[np.ndarray], sizes: np.ndarray) -> Node:
    """The radix tree of ``seqs``; ``sizes`` are those of the whole sets."""
    order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
    root = Node(-1, 0)
    path = [root]
    last = np.zeros(0, np.int64)
    for i in order:
        seq = seqs[i]
        m = min(len(last), len(seq))
        differ = last[:m] != seq[:m]
        common = int(differ.argmax()) if differ.any() else m
        below = None
        while path[-1].depth > common:
            below = path.pop()
        if path[-1].depth < common:  # the path forks inside the run of ``below``
            fork = Node(below.source, common)
            path[-1].children[-1] = fork
            fork.children.append(below)
            path.append(fork)
        if len(seq) > common:
            leaf = Node(i, len(seq))
            path[-1].children.append(leaf)
            path.append(leaf)
        path[-1].sets.append(i)
        last = seq
    stack, post = [root], []
    while stack:
        node = stack.pop()
        post.append(node)
        for child in node.children:
            child.parent_depth = node.depth
        stack += node.children
    big = int(sizes.max(initial=0)) + 1
    for node in reversed(post):
        node.smallest = min([*(int(sizes[s]) for s in node.sets), *(c.smallest for c in node.children)], default=big)
        node.longest = max([node.depth, *(c.longest for c in node.children)])
    return root


def links(sets: list[np.ndarray], likeness: int = 80, probes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """(probes, set): those of ``probes`` (all) whose Jaccard likeness to the set is ``likeness`` percent or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    seqs, width = ranked(sets)
    if not width:
        return
    root = build(seqs, sizes)
    who = np.arange(len(sets)) if probes is None else probes
    step = max(1, CELLS // width)
    for at in range(0, len(who), step):
        yield from _traverse(root, seqs, sizes, who[at : at + step], width, likeness)


def _traverse(root: Node, seqs: list[np.ndarray], sizes: np.ndarray, who: np.ndarray, width: int, likeness: int) -> Iterator[tuple[np.ndarray, int]]:
    has = np.zeros((width, len(who)), np.uint8)
    for p, i in enumerate(who):
        has[seqs[i], p] = 1
    size = sizes[who]
    seen = np.concatenate((np.zeros((1, len(who)), np.int32), np.cumsum(has, 0, dtype=np.int32)))
    total = seen[-1]
    stack = [(root, np.arange(len(who)), np.zeros(len(who), np.int32))]
    while stack:
        node, alive, overlap = stack.pop()
        for s in node.sets:
            hit = (100 + likeness) * overlap >= likeness * (size[alive] + sizes[s])
            if hit.any():
                yield who[alive[hit]], s
        for child in node.children:
            run = seqs[child.source][child.parent_depth : child.depth]
            if len(run) == 1:
                got = overlap + has[run[0], alive]
            else:
                got = overlap + has[np.ix_(run, alive)].sum(0, dtype=np.int32)
            left = np.minimum(total[alive] - seen[run[-1] + 1, alive], child.longest - child.depth)
            may = (100 + likeness) * (got + left) >= likeness * (size[alive] + child.smallest)
            if may.all():
                stack.append((child, alive, got))
            elif may.any():
                stack.append((child, alive[may], got[may]))
