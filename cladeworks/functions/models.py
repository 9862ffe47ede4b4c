"""Substitution models: rate matrices, transition probabilities, and the insertion-deletion extension."""

from __future__ import annotations

import numpy as np

from cladeworks.functions import protein_tables
from cladeworks.functions.alphabet import DNA, PROTEIN, Alphabet

MAX_BLEN = 1e5
DNA_MODELS = {"JC69": 0, "K80": 1, "HKY": 1, "TN93": 3, "GTR": 6}  # free parameters
PROTEIN_MODELS = ("WAG", "HIVB", "BLOSUM")


def _lower_triangle(text: str) -> np.ndarray:
    rows = [list(map(float, r.split())) for r in text.strip().split("\n")]
    m = np.zeros((len(rows) + 1, len(rows) + 1))
    for i, r in enumerate(rows, 1):
        m[i, :i] = m[:i, i] = r
    return m


_PROTEIN = {
    "WAG": (_lower_triangle(protein_tables.WAG), np.array(protein_tables.WAG_FREQS.split(), float)),
    "HIVB": (_lower_triangle(protein_tables.HIVB), np.array(protein_tables.HIVB_FREQS.split(), float)),
    "BLOSUM": (_lower_triangle(protein_tables.BLOSUM62), np.array(protein_tables.BLOSUM62_FREQS.split(), float)),
}


def adds_to_one(f: np.ndarray) -> bool:
    total = abs(sum(f.tolist()))
    return abs(total - 1) <= np.finfo(float).eps * max(total, 1.0)


def dna_freqs(given) -> np.ndarray:
    """Four frequencies: too few, or a sum other than 1, give equal ones; of too many the first four count."""
    f = np.array([] if given is None else list(given), float)[:4]
    return f if len(f) == 4 and adds_to_one(f) else np.full(4, 0.25)


class Model:
    """A reversible model: q is normalised to one expected change per unit of time."""

    def __init__(self, name: str, freqs=None, params=()) -> None:
        self.name = name.upper()
        self.params = [float(x) for x in (params if params is not None else [])]
        if self.name in DNA_MODELS:
            self.alphabet: Alphabet = DNA
            self.freqs = dna_freqs(freqs)
            self._complete()
        elif self.name in PROTEIN_MODELS:
            self.alphabet = PROTEIN
            f = np.array([] if freqs is None else list(freqs), float)
            self.freqs = f if len(f) == 20 and adds_to_one(f) else _PROTEIN[self.name][1].copy()
            self.params = []
        else:
            raise ValueError(f"unknown model {name}")
        self._update()

    def _complete(self) -> None:
        if self.name in ("JC69", "K80"):
            self.freqs = np.full(4, 0.25)
        if self.name == "JC69":
            self.params = []
        elif self.name in ("K80", "HKY"):
            self.params = self.params[:1] or [2.0]
        elif self.name == "TN93":
            self.params = (self.params + [1.0] * 3)[:3]
        elif self.name == "GTR" and len(self.params) != 6:
            self.params = (self.params + [1.0] * 5)[:5]

    def _exchange(self) -> np.ndarray:
        if self.name in _PROTEIN:
            return _PROTEIN[self.name][0]
        tc, ta, tg, ca, cg, ag = {
            "JC69": lambda p: (1, 1, 1, 1, 1, 1),
            "K80": lambda p: (p[0], 1, 1, 1, 1, p[0]),
            "HKY": lambda p: (p[0], 1, 1, 1, 1, p[0]),
            "TN93": lambda p: (p[0], p[2], p[2], p[2], p[2], p[1]),
            "GTR": lambda p: (*p, 1.0) if len(p) == 5 else p,
        }[self.name](self.params)
        return np.array([[0, tc, ta, tg], [tc, 0, ca, cg], [ta, ca, 0, ag], [tg, cg, ag, 0]], float)

    def _update(self) -> None:
        q = self._exchange() * self.freqs[None, :]
        np.fill_diagonal(q, 0)
        np.fill_diagonal(q, -q.sum(1))
        self.q = q / -(self.freqs @ np.diag(q))
        self._cache: dict[float, np.ndarray] = {}
        if (self.freqs > 0).all():
            root = np.sqrt(self.freqs)
            values, vectors = np.linalg.eigh(root[:, None] * self.q / root[None, :])
            self.eigen = (values, vectors / root[:, None], (vectors * root[:, None]).T)
        else:
            self.eigen = None

    @property
    def n(self) -> int:
        return len(self.freqs)

    def set_param(self, i: int, value: float) -> None:
        self.params[i] = value
        self._update()

    def set_freqs(self, freqs) -> None:
        f = np.array(freqs, float)
        if self.name in _PROTEIN:
            if len(f) == 20 and adds_to_one(f):
                self.freqs = f
        elif self.name not in ("JC69", "K80"):
            self.freqs = dna_freqs(f)
        self._update()

    def rate(self, a: str, b: str) -> float:
        at = lambda c: max(0, self.alphabet.symbols.find(c.upper()))
        return float(self.q[at(a), at(b)])

    def p(self, t: float) -> np.ndarray:
        """Transition probabilities after t, at most MAX_BLEN."""
        t = min(t, MAX_BLEN)
        found = self._cache.get(t)
        if found is None:
            if self.eigen is not None:
                values, left, right = self.eigen
                found = np.maximum((left * np.exp(values * t)) @ right, 0.0)
            else:
                found = _expm(self.q * t)
            if len(self._cache) > 10_000:
                self._cache.clear()
            self._cache[t] = found
        return found

    def p_many(self, t: np.ndarray) -> np.ndarray:
        """Transition probabilities after each of several times."""
        if self.eigen is None:
            return np.stack([self.p(float(x)) for x in t])
        values, left, right = self.eigen
        return np.maximum((left * np.exp(values * np.minimum(t, MAX_BLEN)[:, None])[:, None, :]) @ right, 0.0)


def _expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling and squaring, for frequencies with zeros."""
    k = max(0, int(np.ceil(np.log2(max(1e-300, np.abs(a).sum(1).max())))) + 4)
    a = a / 2**k
    out = term = np.eye(len(a))
    for i in range(1, 20):
        term = term @ a / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


class IndelModel:
    """Insertions at rate lam, deletions at rate mu per site, substitutions by an inner model; the gap is a state."""

    def __init__(self, inner: str, freqs=None, params=()) -> None:
        own = [float(x) for x in (params if params is not None else [])]
        self.lam, self.mu = (own + [1.5, 1.5])[:2] if len(own) < 2 else own[:2]
        self.inner = Model(inner, freqs, own[2:])
        self.name = f"PIP-{self.inner.name}"

    @property
    def alphabet(self) -> Alphabet:
        return self.inner.alphabet

    @property
    def params(self) -> list[float]:
        return [self.lam, self.mu, *self.inner.params]

    @property
    def freqs(self) -> np.ndarray:
        return np.append(self.inner.freqs, 0.0)

    @property
    def q(self) -> np.ndarray:
        n = self.inner.n
        q = np.zeros((n + 1, n + 1))
        q[:n, :n] = self.inner.q - self.mu * np.eye(n)
        q[:n, n] = self.mu
        return q

    def set_param(self, i: int, value: float) -> None:
        if i == 0:
            self.lam = value
        elif i == 1:
            self.mu = value
        else:
            self.inner.set_param(i - 2, value)

    def set_freqs(self, freqs) -> None:
        self.inner.set_freqs(np.asarray(freqs)[: self.inner.n])

    def p(self, t: float) -> np.ndarray:
        n, alive = self.inner.n, np.exp(-self.mu * t)
        out = np.zeros((n + 1, n + 1))
        out[:n, :n] = alive * self.inner.p(t)
        out[:n, n] = 1 - alive
        out[n, n] = 1
        return out


def make(name: str, freqs=None, params=()):
    """Model by name; ``PIP-<inner>`` has params lambda, mu and those of the inner model."""
    upper = name.upper()
    return IndelModel(upper[4:], freqs, params) if upper.startswith("PIP-") else Model(upper, freqs, params)
