"""What own aligners, scorings, models and costs have to offer to be used in place of the library's."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

import numpy as np

from cladeworks.functions.alphabet import Alphabet
from cladeworks.functions.treelib import Tree


@runtime_checkable
class Aligner(Protocol):
    """Gapped rows, equally long, of unaligned ones along a tree."""

    def align(self, tree: Tree, rows: dict[str, str], alphabet: Alphabet) -> dict[str, str]: ...


@runtime_checkable
class Scoring(Protocol):
    """Costs on a branch of a given length: gaps, and the least cost between a symbol of either set."""

    def open(self, blen: float) -> float: ...

    def ext(self, blen: float) -> float: ...

    def min_match(self, blen: float, a: int, b: int) -> float: ...

    def avg(self, blen: float) -> float: ...


@runtime_checkable
class SubstitutionModel(Protocol):
    alphabet: Alphabet
    params: list[float]

    def p(self, t: float) -> np.ndarray: ...

    def set_param(self, i: int, value: float) -> None: ...

    def set_freqs(self, freqs) -> None: ...


@runtime_checkable
class TreeSearchCost(Protocol):
    """A cost to be maximised over trees; branches_matter tells whether branch lengths change it."""

    tree: Tree
    kept: dict
    branches_matter: bool

    def cost(self) -> float: ...

    def use(self, tree: Tree, kept: dict | None = None, changed: tuple = ()) -> None: ...

    def set_blen(self, i: int, b: float) -> None: ...


@runtime_checkable
class ModelSearchCost(Protocol):
    params: list[float]

    def cost(self) -> float: ...

    def set_param(self, i: int, value: float) -> None: ...

    def set_freqs(self, freqs) -> None: ...
