"""Rooted binary trees in arrays: Newick, traversals, rearrangements, partitions, neighbour joining."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

EPSILON = float(np.finfo(float).eps)
_TOKEN = re.compile(r"\s*(?:([(),;:])|([^\s:,;()\[\]]+))")
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")


class NewickError(ValueError):
    """A text that is no tree."""


@dataclass
class Tree:
    parent: list[int]
    children: list[list[int]]
    blen: list[float]
    label: list[str]
    root: int
    _post: list[int] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.parent)

    @property
    def height(self) -> float:
        return float(sum(self.blen))

    def is_leaf(self, i: int) -> bool:
        return not self.children[i]

    def leaves(self) -> list[int]:
        return [i for i in range(len(self)) if not self.children[i]]

    def preorder(self, start: int | None = None) -> list[int]:
        out, stack = [], [self.root if start is None else start]
        while stack:
            i = stack.pop()
            out.append(i)
            stack.extend(reversed(self.children[i]))
        return out

    def postorder(self) -> list[int]:
        if not self._post:
            out, stack = [], [self.root]
            while stack:
                i = stack.pop()
                out.append(i)
                stack.extend(self.children[i])
            self._post = out[::-1]
        return self._post

    def sibling(self, i: int) -> int | None:
        p = self.parent[i]
        return next((k for k in self.children[p] if k != i), None) if p >= 0 else None

    def copy(self) -> Tree:
        return Tree(self.parent[:], [c[:] for c in self.children], self.blen[:], self.label[:], self.root)

    def leaf_set(self, i: int) -> frozenset[str]:
        return frozenset(self.label[k] for k in self.preorder(i) if not self.children[k])

    def newick(self) -> str:
        """Children in order, inner labels, an outer pair of brackets; whole numbers without a point."""

        def show(x: float) -> str:
            return str(int(x)) if float(x).is_integer() and abs(x) < 1e16 else _plain(x)

        text: dict[int, str] = {}
        for i in self.postorder():
            inner = "(" + ",".join(text.pop(k) for k in self.children[i]) + ")" if self.children[i] else ""
            text[i] = f"{inner}{self.label[i]}:{show(self.blen[i])}"
        return f"({text[self.root]});"


def _plain(x: float) -> str:
    s = repr(float(x))
    return np.format_float_positional(x, trim="-") if "e" in s else s


def parse_newick(text: str) -> list[Tree]:
    """All trees of a text. Leaves need labels, inner nodes two children, the root two or three: a root of three is
    rooted on a new branch of length 0 over its first two. A length that is no number counts as 0; comments are errors."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise NewickError(f"unexpected character at {at}")
        tokens.append(m[1] or m[2])
        at = m.end()
    if tokens and tokens[-1] != ";":
        raise NewickError("no closing semicolon")
    trees, start = [], 0
    for i, t in enumerate(tokens):
        if t == ";":
            trees.append(_one_tree(tokens[start:i]))
            start = i + 1
    return trees


def _one_tree(tokens: list[str]) -> Tree:
    kids: list[list[int]] = []
    label: list[str] = []
    blen: list[float] = []
    open_: list[list[int]] = [[]]
    i, done = 0, False

    def tail(i: int, need: bool) -> tuple[str, float, int]:
        name, length = "", 0.0
        if i < len(tokens) and tokens[i] not in "(),:":
            name, i = tokens[i], i + 1
        if need and not name:
            raise NewickError("a leaf without a label")
        if i < len(tokens) and tokens[i] == ":":
            if i + 1 < len(tokens) and tokens[i + 1] not in "(),:":
                length = float(tokens[i + 1]) if _FLOAT.match(tokens[i + 1]) else 0.0
                i += 2
            else:
                raise NewickError("a length is missing")
        return name, length, i

    expect = True
    while i < len(tokens):
        t = tokens[i]
        if done:
            raise NewickError("text after the tree")
        if t == "(":
            if not expect:
                raise NewickError("unexpected (")
            open_.append([])
            i += 1
        elif t == ",":
            if expect or len(open_) < 2:
                raise NewickError("unexpected ,")
            expect, i = True, i + 1
        elif t == ")":
            if expect or len(open_) < 2:
                raise NewickError("unexpected )")
            below = open_.pop()
            name, length, i = tail(i + 1, False)
            if len(below) == 1 and len(open_) == 1 and i == len(tokens) and not name:
                open_[0].append(below[0])  # outer brackets around the whole tree
                expect, done = False, True
                continue
            if len(below) == 3 and len(open_) == 1:
                kids.append(below[:2])
                label.append("")
                blen.append(0.0)
                below = [len(kids) - 1, below[2]]
            elif len(below) == 3 and len(open_) == 2 and not open_[1]:
                kids.append(below[:2])
                label.append("")
                blen.append(0.0)
                below = [len(kids) - 1, below[2]]
            if len(below) != 2:
                raise NewickError("an inner node without two children")
            kids.append(below)
            label.append(name)
            blen.append(length)
            open_[-1].append(len(kids) - 1)
            expect = False
        elif t == ":":
            raise NewickError("unexpected :")
        else:
            if not expect:
                raise NewickError("unexpected label")
            name, length, i = tail(i, True)
            kids.append([])
            label.append(name)
            blen.append(length)
            open_[-1].append(len(kids) - 1)
            expect = False
    if len(open_) != 1 or len(open_[0]) != 1:
        raise NewickError("brackets do not match")
    parent = [-1] * len(kids)
    for p, c in enumerate(kids):
        for k in c:
            parent[k] = p
    return Tree(parent, kids, blen, label, open_[0][0])


def from_links(links: list[tuple]) -> Tree:
    """A tree from (node_id, parent_id, child_ord, label, blen) rows; ValueError with the reason if they are no binary tree.

    Lengths that are null, not finite or negative count as 0.
    """
    if not links:
        raise ValueError("empty")
    links = sorted(links, key=lambda r: r[0])
    at = {r[0]: i for i, r in enumerate(links)}
    parent = [-1 if r[1] is None else at.get(r[1], -1) for r in links]
    children: list[list[int]] = [[] for _ in links]
    for i in sorted(range(len(links)), key=lambda i: (links[i][2] is None, links[i][2] or 0, links[i][0])):
        if parent[i] >= 0:
            children[parent[i]].append(i)
    roots = [i for i, p in enumerate(parent) if p < 0]
    if len(roots) != 1:
        raise ValueError("no root" if not roots else "several roots")
    if any(len(c) not in (0, 2) for c in children):
        raise ValueError("not binary")
    ok = lambda x: x is not None and np.isfinite(x) and x > 0
    tree = Tree(parent, children, [float(r[4]) if ok(r[4]) else 0.0 for r in links], [r[3] or "" for r in links], roots[0])
    if len(tree.postorder()) != len(links):
        raise ValueError("circle")
    return tree


def check_spr(tree: Tree, prune: int, regraft: int) -> None:
    """Raise ValueError where moving prune to regraft's branch is impossible or changes nothing."""
    if prune == regraft:
        raise ValueError("prune and regraft are the same node")
    if prune == tree.root:
        raise ValueError("the root cannot be pruned")
    if tree.parent[prune] == tree.root:
        raise ValueError("a child of the root cannot be pruned")
    if regraft == tree.root:
        raise ValueError("nothing can be regrafted to the root")
    if regraft in set(tree.preorder(prune)):
        raise ValueError("regraft lies in the pruned subtree")
    if tree.parent[prune] == tree.parent[regraft]:
        raise ValueError("prune and regraft are siblings")


def spr(tree: Tree, prune: int, regraft: int) -> Tree:
    """Prune a subtree and hang it into the middle of regraft's branch; the sum of branch lengths stays."""
    check_spr(tree, prune, regraft)
    t = tree.copy()
    joint, other = t.parent[prune], t.sibling(prune)
    above = t.parent[joint]
    t.children[above] = [k for k in t.children[above] if k != joint] + [other]  # the sibling takes the joint's place, last
    t.parent[other] = above
    t.blen[other] += t.blen[joint]
    host = t.parent[regraft]
    half = t.blen[regraft] / 2
    t.children[host] = [k for k in t.children[host] if k != regraft] + [joint]
    t.parent[joint], t.blen[joint] = host, half
    t.children[joint] = [k for k in t.children[joint] if k != other] + [regraft]
    t.parent[regraft], t.blen[regraft] = joint, half
    return t


def regraft_places(tree: Tree, prune: int) -> list[int]:
    """Preorder without the pruned subtree, the root, the joint and the sibling."""
    out = {tree.root, tree.parent[prune], tree.sibling(prune), *tree.preorder(prune)}
    return [i for i in tree.preorder() if i not in out]


def partitions(tree: Tree) -> list[frozenset[str]]:
    """Both sides of the split at each branch, in preorder; the two root branches are one split."""
    every = tree.leaf_set(tree.root)
    out: list[frozenset[str]] = []
    seen: set[frozenset[str]] = set()
    for i in tree.preorder():
        if i != tree.root and (s := tree.leaf_set(i)) not in seen:
            for side in (s, every - s):
                out.append(side)
                seen.add(side)
    return out


def robinson_foulds(a: Tree, b: Tree) -> int:
    """Partitions of a, over the leaves both have, that b lacks; directed, each side of a split counts."""
    common = a.leaf_set(a.root) & b.leaf_set(b.root)
    own = [s & common for s in partitions(a)]
    there = {s & common for s in partitions(b)}
    return sum(1 for s in own if s and s not in there)


def neighbour_joining(distance: np.ndarray, labels: list[str]) -> Tree:
    """Neighbour joining; among minima equal to nine places the first pair in row order of the lower triangle is joined."""
    n = len(labels)
    if n == 0:
        raise ValueError("no sequences")
    total = 2 * n - 1
    parent, children, blen = [-1] * total, [[] for _ in range(total)], [0.0] * total
    d, ids = np.array(distance, float), list(range(n))
    for new in range(n, total):
        m = len(ids)
        s = d.sum(1)
        if m > 2:
            q = np.round((m - 2) * d - s[:, None] - s[None, :], 9)
            q[np.triu_indices(m)] = np.inf
            i, j = divmod(int(q.argmin()), m)
            bi = d[i, j] / 2 + (s[i] - s[j]) / (2 * (m - 2))
            bj = d[i, j] - bi
        else:
            i, j = 1, 0
            bi = bj = d[1, 0] / 2
        for k, b in ((i, bi), (j, bj)):
            blen[ids[k]] = b if b > 0 else EPSILON
            parent[ids[k]] = new
        children[new] = [ids[i], ids[j]]
        rest = [k for k in range(m) if k not in (i, j)]
        joined = (d[rest, i] + d[rest, j] - d[i, j]) / 2
        grown = np.zeros((len(rest) + 1, len(rest) + 1))
        grown[:-1, :-1] = d[np.ix_(rest, rest)]
        grown[-1, :-1] = grown[:-1, -1] = joined
        d, ids = grown, [ids[k] for k in rest] + [new]
    return Tree(parent, children, blen, list(labels) + [""] * (total - n), total - 1)


def node_maps(tree: Tree, rows: dict[str, str]) -> dict[int, tuple[list, list]]:
    """For each inner node the maps of its two children into the node's own columns: positions, null where the child has
    only gaps. A node's columns are those in which any leaf below it has a residue."""
    there: dict[int, np.ndarray] = {}
    out = {}
    for i in tree.postorder():
        if not tree.children[i]:
            there[i] = np.array([c != "-" for c in rows[tree.label[i]]], bool)
        else:
            x, y = (there.pop(k) for k in tree.children[i])
            own = x | y
            maps = []
            for side in (x, y):
                place = np.cumsum(side) - 1
                maps.append([int(place[k]) if side[k] else None for k in np.flatnonzero(own)])
            out[i], there[i] = tuple(maps), own
    return out


def levenshtein(a: str, b: str) -> int:
    """Unit-cost edit distance, one numpy row at a time."""
    if not a or not b:
        return len(a) + len(b)
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row, place = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        step = np.minimum(row[:-1] + (y != c), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i], step]) - place) + place
    return int(row[-1])


def corrected_distance(edits: float, longest: int) -> float:
    """Jukes-Cantor correction of an edit share, saturated just below 3/4."""
    share = min(edits / longest if longest else 0.0, 0.75 - EPSILON)
    return float(-0.75 * np.log(1 - 4 / 3 * share))
