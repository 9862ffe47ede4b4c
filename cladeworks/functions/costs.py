"""Costs of an alignment on a tree, over distinct site patterns: substitution and indel likelihoods, parsimony scores.

Every cost is to be maximised and is a sum over columns, so columns that look alike are evaluated once and weighted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from cladeworks.functions.alphabet import GAP, Alphabet
from cladeworks.functions.models import MAX_BLEN, IndelModel, Model
from cladeworks.functions.treelib import Tree

SHIFT = math.log(2 * math.pi) / 2
SIDE_BY_SIDE = 1 << 18  # values of partials of regraft places that are optimised together
TOGETHER = 1 << 16  # values of partials of regraft places that are worked out together
SLACK = 1e-3  # by so much a place has to stay below others to be left out, for rounding
GRID = np.linspace(0, 1, 25)  # points of a branch's range between which its cost is bounded
TANGENTS = 4  # of a place that may be the best, before its branch is searched
LEAST_SITE = 1e-7  # sites of partials with 1 as the greatest that are exact enough for a bound
LEAST_LOG = math.log(np.finfo(float).tiny)


def stirling(n: float) -> float:
    """Stirling's ln n! with its first correction."""
    return n * math.log(n) - n + math.log(n) / 2 + 1 / (12 * n) + SHIFT if n > 0 else float("nan")


def site_patterns(rows: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(leaf x pattern code points, weights, number of columns), columns of gaps only left out. Rows are equally long."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("sequences are not aligned")
    if not rows or not rows[0]:
        return np.zeros((len(rows), 0), np.uint8), np.zeros(0), 0
    grid = np.frombuffer("".join(rows).encode("latin-1"), np.uint8).reshape(len(rows), -1)
    grid = grid[:, (grid != ord(GAP)).any(0)]
    if not grid.shape[1]:
        return grid, np.zeros(0), 0
    found, counts = np.unique(grid, axis=1, return_counts=True)
    return found, counts.astype(float), grid.shape[1]


class Cost:
    """Shared part: patterns by leaf, and partial results kept by node until something below or at the node changes."""

    branches_matter = True

    def __init__(self, tree: Tree, rows: dict[str, str], alphabet: Alphabet) -> None:
        self.alphabet = alphabet
        leaves = [tree.label[i] for i in tree.leaves()]
        missing, extra = sorted(set(leaves) - set(rows)), sorted(set(rows) - set(leaves))
        if missing or extra:
            raise ValueError(f"leaves without sequences: {missing}" if missing else f"sequences without leaves: {extra}")
        if not all(alphabet.is_word(rows[x]) for x in leaves):
            raise ValueError(f"letters that are not of the {alphabet.name} alphabet")
        grid, self.weights, self.columns = site_patterns([rows[x] for x in leaves])
        self.codes = dict(zip(leaves, grid, strict=True))
        self.use(tree)

    def use(self, tree: Tree, kept: dict | None = None, changed: tuple = ()) -> None:
        """Go on with another tree; kept are results for it that hold except at and above the changed nodes."""
        self.tree, self.kept = tree, dict(kept or {})
        for i in changed:
            while i >= 0:
                self.kept.pop(i, None)
                i = tree.parent[i]

    def set_blen(self, i: int, b: float) -> None:
        self.tree.blen[i] = b
        while i >= 0:
            self.kept.pop(i, None)
            i = self.tree.parent[i]

    def node(self, i: int):
        raise NotImplementedError

    def walk(self):
        for i in self.tree.postorder():
            if i not in self.kept:
                self.kept[i] = self.node(i)
        return self.kept[self.tree.root]


def _to_one(part: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partials with 1 as the greatest of each column, what was taken out being added to the logarithms."""
    top = part.max(-2)
    top = np.where(top > 0, top, 1.0)
    return part / top[..., None, :], log + np.log(top)


def _not_tiny(part: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partials rescaled where they become tiny."""
    top = part.max(-2, initial=0.0)
    low = (top < 1e-100) & (top > 0)
    if low.any():
        part = np.where(low[..., None, :], part / np.where(low, top, 1)[..., None, :], part)
        log = log + np.where(low, np.log(np.where(low, top, 1)), 0)
    return part, log


class _Sheets(NamedTuple):
    """Arrays with a row for each node: partials of its branch's upper end and their logarithms, transitions along the
    branch and half of it, and what _seen gives for its lower end."""

    below: np.ndarray
    below_log: np.ndarray
    full: np.ndarray
    half: np.ndarray
    inner: np.ndarray
    shift: np.ndarray
    middle: np.ndarray
    along: np.ndarray | None


class SubstitutionCost(Cost):
    """Log-likelihood by pruning; gaps are missing data. Partials are rescaled, so deep trees do not underflow."""

    def __init__(self, tree: Tree, rows: dict[str, str], model: Model) -> None:
        self.model, self.table = model, model.alphabet.indicators()
        self.kept: dict = {}
        self.sheets: _Sheets | None = None
        self.stale: list[int] = []
        self.room: tuple[np.ndarray, ...] | None = None  # for partials of all nodes, used again and again
        super().__init__(tree, rows, model.alphabet)

    def node(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        kids = self.tree.children[i]
        if kids:
            (x, lx), (y, ly) = self.kept[kids[0]], self.kept[kids[1]]
            return self._along(self.tree.blen[i], x * y, lx + ly)
        return self._along(self.tree.blen[i], self._leaf(i), np.zeros(len(self.weights)))

    def _leaf(self, i: int) -> np.ndarray:
        return self.table[self.codes[self.tree.label[i]]].T

    def _along(self, b: float, part: np.ndarray, log: np.ndarray, down: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Partials at a branch's other end, rescaled where they become tiny; down goes from its upper to its lower end."""
        p = self.model.p(b)
        return _not_tiny((p.T if down else p) @ part, log)

    def cost(self) -> float:
        part, log = self.walk()
        with np.errstate(divide="ignore"):
            return float(self.weights @ (np.log(self.model.freqs @ part) + log)) if self.columns else 0.0

    def use(self, tree: Tree, kept: dict | None = None, changed: tuple = ()) -> None:
        sheets = self.sheets if kept is not None and kept is self.kept else None
        super().use(tree, kept, changed)
        self.above: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sheets = sheets
        self.stale = [] if sheets is None else sorted({*self.stale, *(i for i in range(len(tree)) if i not in self.kept)})

    def set_blen(self, i: int, b: float) -> None:
        super().set_blen(i, b)
        self.sheets = None
        known, self.above = self.above, {}  # what lies outside of a part that holds the branch is as before
        while i >= 0:
            if i in known:
                self.above[i] = known[i]
            i = self.tree.parent[i]

    def _below(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Partials at the upper end of a node's branch; only what is missing below is worked out."""
        missing, stack = [], [i]
        while stack:
            k = stack.pop()
            if k not in self.kept:
                missing.append(k)
                stack.extend(self.tree.children[k])
        for k in reversed(missing):
            self.kept[k] = self.node(k)
        return self.kept[i]

    def _above(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Partials of all that is not below a node's branch, at its upper end, the root's frequencies included."""
        tree, way = self.tree, []
        while i >= 0 and i not in self.above:
            way.append(i)
            i = tree.parent[i]
        for k in reversed(way):
            p = tree.parent[k]
            if p < 0:
                self.above[k] = np.repeat(self.model.freqs[:, None], len(self.weights), 1), np.zeros(len(self.weights))
            else:
                part, log = self._along(tree.blen[p], *self.above[p], down=True)
                x, lx = self._below(tree.sibling(k))
                self.above[k] = part * x, log + lx
            i = k
        return self.above[i]

    def best_length(self, i: int, low: float, high: float) -> tuple[float, float]:
        """(length, cost) of the best length between low and high found for one branch."""
        from cladeworks.functions.optimise import brent

        if not self.columns:
            return brent(lambda b: 0.0, low, high)[0], 0.0
        outer, log = self._above(i)
        kids = self.tree.children[i]
        (x, lx), (y, ly) = (self._below(k) for k in kids) if kids else ((self._leaf(i), 0.0), (1.0, 0.0))
        outer, log = _to_one(outer, log + lx + ly)
        inner, log = _to_one(x * y, log)
        shift = float(self.weights @ log)
        if self.model.eigen is None:
            at = lambda b: self._met(b, outer, inner) + shift
        else:
            values, left, right = self.model.eigen
            terms = (left.T @ outer) * (right @ inner)
            at = lambda b: self._summed(np.exp(values * min(b, MAX_BLEN)) @ terms) + shift
        b, _ = brent(lambda b: math.inf if math.isnan(v := at(b)) else -v, low, high)
        return b, self._met(b, outer, inner) + shift

    def _summed(self, sites: np.ndarray) -> float:
        with np.errstate(divide="ignore"):
            return float(self.weights @ np.log(np.maximum(sites, 0.0)))

    def _met(self, b: float, outer: np.ndarray, inner: np.ndarray) -> float:
        return self._summed((outer * (self.model.p(b) @ inner)).sum(0))

    def _side(self) -> _Sheets:
        """What regrafts need of every node, side by side; after a move only the rows of nodes that it changed are new."""
        if self.sheets is None or self.stale:
            self.walk()
            rows = self.stale if self.sheets is not None else list(range(len(self.tree)))
            blens = np.array(self.tree.blen)[rows]
            joined = [self._joined(i) for i in rows]
            half = self.model.p_many(blens / 2)
            found = _Sheets(
                np.stack([self.kept[i][0] for i in rows]), np.stack([self.kept[i][1] for i in rows]), self.model.p_many(blens), half,
                *self._seen(np.stack([x for x, _ in joined]), np.stack([log for _, log in joined]), half),
            )
            if self.sheets is None:
                self.sheets = found
            for x, y in zip(self.sheets, found, strict=True):
                if x is not None and x is not y:
                    x[rows] = y
            self.stale = []
        return self.sheets

    def _joined(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Partials at the lower end of a node's branch."""
        kids = self.tree.children[i]
        if not kids:
            return self._leaf(i), np.zeros(len(self.weights))
        (x, lx), (y, ly) = self.kept[kids[0]], self.kept[kids[1]]
        return x * y, lx + ly

    def _seen(self, inner: np.ndarray, log: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Partials at the lower ends of branches with 1 as the greatest, their shares of the cost, the partials in the
        middles of the branches, and their parts along the model's eigenvectors."""
        inner, log = _to_one(inner, log)
        return inner, log @ self.weights, half @ inner, None if self.model.eigen is None else self.model.eigen[2] @ inner

    def regraft_costs(self, prune: int, places: list[int], base: float | None = None, least: float | None = None) -> list[tuple[float, float | None]]:
        """(cost, length of the regraft branch or None) of each place's tree, in one pass over what is left of the tree.

        Partials from below and from above meet in the middle of each branch with those of the pruned part. Where that
        does not beat base, the lower half of the branch is optimised, for which only its own transition matrix changes.
        With least only the best place is asked for, and only if it is above least: a place that cannot come above both
        least and the best of the others, whatever the half's length, is not optimised.
        """
        if not self.columns:
            return [(0.0, None)] * len(places)
        tree, s, weights = self.tree, self._side(), self.weights
        joint, other = tree.parent[prune], tree.sibling(prune)
        upper = tree.parent[joint]
        of = lambda i: [other if k == joint else k for k in tree.children[i]] if i == upper else tree.children[i]
        way, i = [], upper
        while i != tree.root:
            way.append(i)
            i = tree.parent[i]
        self.sheets = None  # they hold other values until those of the way are put back
        held = [(x, x[[other, *way]]) for x in s if x is not None]
        s.below[other], s.below_log[other] = self._along(tree.blen[joint], s.below[other], s.below_log[other])  # its branch takes over the joint's
        s.full[other] = self.model.p(tree.blen[other] + tree.blen[joint])
        inner, inner_log = np.empty((len(way), *s.below.shape[1:])), np.empty((len(way), len(weights)))
        for k, i in enumerate(way):
            x, y = of(i)
            np.multiply(s.below[x], s.below[y], out=inner[k])
            np.add(s.below_log[x], s.below_log[y], out=inner_log[k])
            s.below[i], s.below_log[i] = self._along(tree.blen[i], inner[k], inner_log[k])
        if way:
            found = self._seen(inner, inner_log, s.half[way])
            s.inner[way], s.shift[way], s.middle[way] = found[:3]
            if s.along is not None:
                s.along[way] = found[3]

        seen, up, logs = self._middles(of, s)
        own, own_log = _to_one(*self.kept[prune])
        at = {place: k for k, place in enumerate(places)}
        out: list[tuple[float, float | None]] = [(-math.inf, None)] * len(places)
        open_: list[tuple[int, float, np.ndarray, np.ndarray, float]] = []
        bar = lambda: -math.inf if least is None else max(least, max(v for v, _ in out)) - SLACK
        width = max(1, TOGETHER // own.size)
        for first in range(0, len(seen), width):
            some, part, log = seen[first : first + width], up[first : first + width], logs[first : first + width]
            outer = part * own
            sites = np.einsum("kas,kas->ks", outer, s.middle[some])
            if not sites.min() > 1e-200:
                part, log = _to_one(part, log)
                outer, log = _to_one(part * own, log)
                sites = np.einsum("kas,kas->ks", outer, s.middle[some])
            shift = (log + own_log) @ weights + s.shift[some]
            with np.errstate(divide="ignore"):
                values = np.log(sites) @ weights + shift
            for place, value in zip(some, values.tolist(), strict=True):
                if place in at:
                    out[at[place]] = value, None
            worse = [] if base is None else [k for k, v in enumerate(values.tolist()) if not v > base and some[k] in at]
            if worse and least is not None and s.along is not None:
                chosen = [some[k] for k in worse]
                halves = np.array(tree.blen)[chosen] / 2
                terms = (self.model.eigen[1].T @ (outer if len(worse) == len(some) else outer[worse])) * s.along[chosen]
                tops = self._tops(terms, halves, *self._grid(halves), sites[worse])
                most = values[worse] + tops.max(1)
                low = bar()
                worse = [k for k, m in zip(worse, most.tolist(), strict=True) if not m < low]
            to_one, extra = _to_one(outer[worse], np.zeros((len(worse), len(weights)))) if worse else ((), ())
            for k, part, log in zip(worse, to_one, extra, strict=True):
                open_.append((at[some[k]], tree.blen[some[k]] / 2, part, s.inner[some[k]], float(shift[k] + weights @ log)))
                if len(open_) * own.size >= SIDE_BY_SIDE:
                    self._best_halves(self._within_reach(open_, bar()), out)
                    open_ = []
        if open_:
            self._best_halves(self._within_reach(open_, bar()), out)
        for x, values in held:
            x[[other, *way]] = values
        self.sheets = s
        return out

    def _middles(self, of: Callable[[int], list[int]], s: _Sheets) -> tuple[list[int], np.ndarray, np.ndarray]:
        """All nodes but the root of the tree with children of(i), and the partials of all that is not below them in the
        middles of their branches, from the root down a level of nodes at a time."""
        tree, seen = self.tree, []
        if self.room is None or self.room[0].shape != s.below.shape:
            self.room = np.empty_like(s.below), np.empty_like(s.below), np.empty_like(s.below_log)
        up, room, logs = self.room
        nodes, down, log = [tree.root], np.repeat(self.model.freqs[:, None], len(self.weights), 1)[None], np.zeros((1, len(self.weights)))
        while nodes:
            pairs = [of(i) for i in nodes]
            kids, beside = [k for x, y in pairs for k in (x, y)], [k for x, y in pairs for k in (y, x)]
            above = s.below.take(beside, 0, out=room[: len(kids)], mode="clip")
            of_pairs = above.reshape(len(nodes), 2, *above.shape[1:])
            of_pairs *= down[:, None]
            here = slice(len(seen), len(seen) + len(kids))
            log = np.add(np.repeat(log, 2, 0), s.below_log[beside], out=logs[here])
            np.matmul(s.half[kids].transpose(0, 2, 1), above, out=up[here])
            seen += kids
            further = [k for k, i in enumerate(kids) if tree.children[i]]
            nodes = [kids[k] for k in further]
            if nodes:
                down, log = _not_tiny(s.full[nodes].transpose(0, 2, 1) @ above[further], log[further])
        return seen, up[: len(seen)], logs[: len(seen)]

    def _within_reach(self, open_: list[tuple[int, float, np.ndarray, np.ndarray, float]], bar: float) -> list:
        """Those of the open places that may come to bar, by tangents where those before let them come highest."""
        if bar == -math.inf or self.model.eigen is None:
            return open_
        _, left, right = self.model.eigen
        halves, shifts = np.array([x[1] for x in open_]), np.array([x[4] for x in open_])
        terms = (left.T @ np.stack([x[2] for x in open_])) * (right @ np.stack([x[3] for x in open_]))
        grid, powers = self._grid(halves)
        which, most, b = np.arange(len(open_)), np.full((len(open_), len(GRID) - 1), math.inf), grid[:, 0]
        for _ in range(TANGENTS):
            tops = self._tops(terms, b, grid, powers) + (np.log(np.maximum(self._sites(terms, b), LEAST_SITE)) @ self.weights + shifts)[:, None]
            most = np.minimum(most, tops)
            on = ~(most.max(1) < bar)
            which, most, terms, shifts, grid, powers = (x[on] for x in (which, most, terms, shifts, grid, powers))
            if not len(which):
                break
            top = most.argmax(1)
            b = (grid[np.arange(len(which)), top] + grid[np.arange(len(which)), top + 1]) / 2
        return [open_[k] for k in which]

    def _sites(self, terms: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.exp(np.minimum(b, MAX_BLEN)[:, None, None] * self.model.eigen[0]) @ terms)[:, 0]

    def _grid(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths between which half branches are searched, and the exponentials of the eigenvalues times the lengths."""
        low, high = np.where(halves == 0, 0.0, 0.1 * halves), np.where(halves == 0, 1.0, np.minimum(MAX_BLEN, 10 * halves))
        with np.errstate(all="ignore"):
            grid = np.where((halves == 0)[:, None], GRID, low[:, None] * (high / low)[:, None] ** GRID)
        grid[:, -1] = high
        return grid, np.exp(grid[:, :, None] * self.model.eigen[0])

    def _tops(self, terms: np.ndarray, b: np.ndarray, grid: np.ndarray, powers: np.ndarray, sites: np.ndarray | None = None) -> np.ndarray:
        """What a half branch in each interval of the grid can add at most to the cost with length b, for each place.

        The cost is concave in the exponentials of the eigenvalues times the length, so it lies below its tangent at b,
        which is a sum of exponentials of the length. Within an interval that is bounded by its values at both ends and
        its curvature. Infinite where rounding leaves no bound: sites, if given, are the sums of terms by another way.
        """
        known = self._sites(terms, b)
        with np.errstate(all="ignore"):
            slope = (terms @ (self.weights / known)[:, :, None])[:, :, 0]
            fit = (known > LEAST_SITE).all(1) if sites is None else (np.abs(known - sites) <= 1e-7 * sites).all(1)
            tangent = (powers @ slope[:, :, None])[:, :, 0]
            bend = (powers[:, :-1] @ (np.abs(slope) * self.model.eigen[0] ** 2)[:, :, None])[:, :, 0]
            gain = np.maximum(tangent[:, :-1], tangent[:, 1:]) + np.diff(grid, axis=1) ** 2 / 8 * bend - self.weights.sum()  # the tangent at b
        return np.where((fit & (grid[:, 0] < grid[:, -1]))[:, None] & np.isfinite(gain), gain, math.inf)

    def _best_halves(self, open_: list[tuple[int, float, np.ndarray, np.ndarray, float]], out: list[tuple[float, float | None]]) -> None:
        """Put the best length of the lower half of a branch, and its cost, where it is better than the half's own."""
        from cladeworks.functions.optimise import branch_range, brent_many

        if not open_:
            return
        ranges = np.array([branch_range(half) for _, half, _, _, _ in open_])
        shifts = np.array([shift for *_, shift in open_])
        outers, inners = np.stack([o for _, _, o, _, _ in open_]), np.stack([n for _, _, _, n, _ in open_])
        if self.model.eigen is None:
            sites = lambda b, which: np.stack([(outers[k] * (self.model.p(float(x)) @ inners[k])).sum(0) for x, k in zip(b, which, strict=True)])
        else:
            values, left, right = self.model.eigen
            terms = (left.T @ outers) * (right @ inners)

            def sites(b: np.ndarray, which: np.ndarray) -> np.ndarray:
                some = terms if len(which) == len(terms) else terms[which]
                return (np.exp(np.minimum(b, MAX_BLEN)[:, None, None] * values) @ some)[:, 0]

        def less(b: np.ndarray, which: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore"):
                found = -(np.log(np.maximum(sites(b, which), 0.0)) @ self.weights + shifts[which])
            return np.where(np.isnan(found), np.inf, found)

        lengths, _ = brent_many(less, ranges[:, 0], ranges[:, 1])
        for (at, _, outer, inner, shift), b in zip(open_, lengths.tolist(), strict=True):
            value = self._met(b, outer, inner) + shift
            if value > out[at][0]:
                out[at] = value, b

    @property
    def params(self) -> list[float]:
        return self.model.params

    def set_param(self, i: int, value: float) -> None:
        self.model.set_param(i, value)
        self.use(self.tree)

    def set_freqs(self, freqs) -> None:
        self.model.set_freqs(freqs)
        self.use(self.tree)


class IndelCost(Cost):
    """Log-likelihood under insertions and deletions as events of their own, the gap being a state."""

    def __init__(self, tree: Tree, rows: dict[str, str], model: IndelModel) -> None:
        self.model = model
        table = model.alphabet.indicators()
        self.table = table / table.sum(1, keepdims=True)
        super().__init__(tree, rows, model.alphabet)

    def node(self, i: int) -> tuple:
        m, tree, n = self.model, self.tree, self.model.inner.n
        b = tree.blen[i]
        weight = m.lam / m.mu * (1.0 if i == tree.root else 1 - math.exp(-m.mu * b))
        pi = m.inner.freqs
        kids = tree.children[i]
        if not kids:
            codes = self.codes[tree.label[i]]
            there = codes != ord(GAP)
            part = np.zeros((n + 1, len(codes)))
            part[:n] = np.where(there, self.table[codes].T, 0)
            part[n] = ~there
            f = (pi @ part[:n]) * there
            return part, there.astype(float), f * weight, -1.0, -weight
        (fx, ax, px, cx, ex), (fy, ay, py, cy, ey) = self.kept[kids[0]], self.kept[kids[1]]
        bx, by = tree.blen[kids[0]], tree.blen[kids[1]]
        part = (m.p(bx) @ fx) * (m.p(by) @ fy)
        f = pi @ part[:n]
        both = ax + ay
        alone = both == 2
        gain = np.where(alone, f * weight, f * both * weight + ax * px + ay * py)
        c = (1 + math.exp(-m.mu * bx) * cx) * (1 + math.exp(-m.mu * by) * cy) - 1
        return part, (both > 0).astype(float), gain, c, weight * c + ex + ey

    def pieces(self) -> tuple[float, float]:
        """(sum over columns, term of the empty column)."""
        _, _, gain, _, empty = self.walk()
        tiny = gain < np.finfo(float).tiny
        logs = np.where(tiny, LEAST_LOG, np.log(np.where(tiny, 1.0, gain)))
        return float(self.weights @ logs), float(empty)

    def cost(self) -> float:
        total, empty = self.pieces()
        return total + empty - stirling(self.columns)

    @property
    def params(self) -> list[float]:
        return self.model.params

    def set_param(self, i: int, value: float) -> None:
        self.model.set_param(i, value)
        self.kept = {}

    def set_freqs(self, freqs) -> None:
        self.model.set_freqs(freqs)
        self.kept = {}


class FitchCost(Cost):
    """Minus the least number of changes, gaps being a symbol of their own."""

    branches_matter = False

    def __init__(self, tree: Tree, rows: dict[str, str], alphabet: Alphabet) -> None:
        self.table = alphabet.masks()
        super().__init__(tree, rows, alphabet)

    def node(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        kids = self.tree.children[i]
        if not kids:
            return self.table[self.codes[self.tree.label[i]]], np.zeros(len(self.weights), np.int64)
        (x, kx), (y, ky) = self.kept[kids[0]], self.kept[kids[1]]
        both = x & y
        return np.where(both == 0, x | y, both), kx + ky + (both == 0)

    def cost(self) -> float:
        return -float(self.weights @ self.walk()[1])

    def regraft_costs(self, prune: int, places: list[int], base: float | None = None, least: float | None = None) -> list[tuple[float, float | None]]:
        """(cost, None) of each place's tree, all in one pass: what is left of the tree has the same cost seen from any branch,
        and hanging the pruned part there costs a change where the sets on both sides of the branch share nothing with it."""
        self.walk()
        tree, join = self.tree, lambda x, y: np.where((x & y) == 0, x | y, x & y)
        joint, other = tree.parent[prune], tree.sibling(prune)
        kids = {i: [other if k == joint else k for k in tree.children[i]] for i in (tree.parent[joint],)}
        of = lambda i: kids.get(i, tree.children[i])
        below = {i: kept[0] for i, kept in self.kept.items()}
        changes = {i: kept[1] for i, kept in self.kept.items()}
        i = tree.parent[joint]
        while i >= 0:  # the nodes above the joint see the tree without the pruned part
            x, y = of(i)
            below[i], changes[i] = join(below[x], below[y]), changes[x] + changes[y] + ((below[x] & below[y]) == 0)
            i = tree.parent[i]
        above: dict[int, np.ndarray] = {}
        stack = [tree.root]
        while stack:
            i = stack.pop()
            pair = of(i)
            for k, beside in zip(pair, reversed(pair), strict=True):
                above[k] = below[beside] if i == tree.root else join(above[i], below[beside])
                stack.append(k)
        own = below[prune]
        least = float(self.weights @ (changes[tree.root] + changes[prune]))
        return [(-(least + float(self.weights @ ((join(above[p], below[p]) & own) == 0))), None) for p in places]


class SimpleScoring:
    """Equal mismatch cost, gap costs as multiples of it, branch lengths ignored."""

    def __init__(self, mismatch: float = 1.0, gap_open: float = 1.0, gap_ext: float = 1.0) -> None:
        self.mismatch, self._open, self._ext = mismatch, gap_open * mismatch, gap_ext * mismatch

    def open(self, blen: float) -> float:
        return self._open

    def ext(self, blen: float) -> float:
        return self._ext

    def table(self, blen: float) -> np.ndarray | None:
        return None

    def min_match(self, blen: float, a: int, b: int) -> float:
        return 0.0 if a & b or not a or not b else self.mismatch

    def avg(self, blen: float) -> float:
        return self.mismatch


class ModelScoring:
    """-ln P(t) at chosen times; a branch takes the nearest time, the smaller one of two equally near."""

    def __init__(self, model: Model, times: list[float], gap_open: float = 2.5, gap_ext: float = 1.0, zero_diagonal: bool = False, digits: int | None = None) -> None:
        self.times = sorted(times)
        self.tables = []
        for t in self.times:
            with np.errstate(divide="ignore"):
                c = -np.log(model.p(t))
            if digits is not None:
                c = np.sign(c) * np.floor(np.abs(c) * 10**digits + 0.5) / 10**digits
            if zero_diagonal:
                np.fill_diagonal(c, 0.0)
            self.tables.append(c)
        self._open, self._ext, self._known = gap_open, gap_ext, {}

    def at(self, blen: float) -> int:
        return min(range(len(self.times)), key=lambda i: (abs(self.times[i] - blen), self.times[i]))

    def table(self, blen: float) -> np.ndarray:
        return self.tables[self.at(blen)]

    def avg(self, blen: float) -> float:
        return float(self.table(blen).mean())

    def open(self, blen: float) -> float:
        return self._open * self.avg(blen)

    def ext(self, blen: float) -> float:
        return self._ext * self.avg(blen)

    def min_match(self, blen: float, a: int, b: int) -> float:
        key = (self.at(blen), a, b)
        if key not in self._known:
            t = self.tables[key[0]]
            n = len(t)
            x, y = [i for i in range(n) if a >> i & 1], [i for i in range(n) if b >> i & 1]
            self._known[key] = float(t[np.ix_(x, y)].min()) if x and y else 0.0
        return self._known[key]


class DolloCost(Cost):
    """Minus the cost with a single gain of each column's residues, deletions and substitutions being scored."""

    branches_matter = False

    def __init__(self, tree: Tree, rows: dict[str, str], alphabet: Alphabet, scoring=None) -> None:
        self.table, self.scoring = alphabet.masks(), scoring or SimpleScoring()
        super().__init__(tree, rows, alphabet)
        self.total = sum((c != ord(GAP)).astype(np.int64) for c in self.codes.values())

    def node(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kids = self.tree.children[i]
        if not kids:
            codes = self.codes[self.tree.label[i]]
            return self.table[codes], np.zeros(len(codes)), (codes != ord(GAP)).astype(np.int64)
        (x, kx, nx), (y, ky, ny) = self.kept[kids[0]], self.kept[kids[1]]
        gap, b = self.alphabet.gap_mask, self.tree.blen[i]
        both, either = x & y, (x | y) & ~gap
        above = (nx == self.total) | (ny == self.total)  # all residues lie below one child: nothing was inserted yet
        added = np.zeros(len(x))
        pick = lambda a, c, where: np.array([self.scoring.min_match(b, int(p) & ~gap, int(q) & ~gap) for p, q in zip(a[where], c[where], strict=True)])
        same = (both != 0) & (both != gap)
        added[same] = pick(both, both, same)
        gone = (both == 0) & ~above & ((x == gap) | (y == gap))
        added[gone] = self.scoring.open(b)
        changed = (both == 0) & ~above & (x != gap) & (y != gap)
        added[changed] = pick(x, y, changed)
        sets = np.where(both != 0, both, np.where(above, gap, either))
        return sets, kx + ky + added, nx + ny

    def cost(self) -> float:
        return -float(self.weights @ self.walk()[1])


def empirical_freqs(rows: list[str], alphabet: Alphabet) -> np.ndarray:
    """Shares of the symbols, an ambiguous letter split evenly over its members, gaps left out; a symbol that does not
    occur counts 1 before the shares are taken."""
    f = np.zeros(alphabet.n)
    for r in rows:
        for c in alphabet.symbols + alphabet.codes:
            k = r.count(c)
            if k:
                ind = alphabet.indicator(c)
                f += k * ind / ind.sum()
    f[f == 0] = 1.0
    return f / f.sum()
