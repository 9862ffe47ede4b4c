"""Alphabets: symbols, ambiguity codes, masks and encodings, as lookup tables and as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol order (frequencies and rates go by it) and the members of the ambiguity codes; every other
# accepted code stands for all symbols.
DNA_SYMBOLS, DNA_CODES = "TCAG", "RYSWKMBDHVNZX"
PROTEIN_SYMBOLS, PROTEIN_CODES = "ARNDCQEGHILKMFPSTWYV", "BJZX"
DNA_MEMBERS = {"M": "CA", "R": "AG", "W": "TA", "S": "CG", "Y": "TC", "K": "TG", "V": "CAG", "D": "TAG", "B": "TCG", "H": "TCA"}
PROTEIN_MEMBERS = {"B": "DN", "Z": "EQ", "J": "IL"}
GAP = "-"


@dataclass(frozen=True)
class Alphabet:
    name: str
    symbols: str
    codes: str
    members_of: dict

    @property
    def n(self) -> int:
        return len(self.symbols)

    @property
    def gap_mask(self) -> int:
        return 1 << self.n

    @property
    def full_mask(self) -> int:
        return (1 << self.n) - 1

    def members(self, ch: str) -> str:
        ch = ch.upper()
        return ch if ch in self.symbols else self.members_of.get(ch, self.symbols)

    def mask(self, ch: str) -> int:
        """Bit set of a symbol: one bit a member, the bit above them for a gap."""
        return self.gap_mask if ch == GAP else sum(1 << self.symbols.index(c) for c in self.members(ch))

    def is_word(self, text: str) -> bool:
        return set(text.upper()) <= {*self.symbols, *self.codes, GAP}

    def indicator(self, ch: str) -> np.ndarray:
        """0/1 over the symbols; a gap is missing data, hence all ones."""
        if ch == GAP:
            return np.ones(self.n)
        return np.array([float(c in self.members(ch)) for c in self.symbols])

    def masks(self) -> np.ndarray:
        """Masks by code point, for texts of single-byte letters."""
        return np.array([self.mask(chr(i)) for i in range(256)], np.int64)

    def indicators(self) -> np.ndarray:
        return np.array([self.indicator(chr(i)) for i in range(256)])

    def show(self, mask: int) -> str:
        return "[" + "".join(sorted(c for i, c in enumerate(self.symbols + GAP) if mask >> i & 1)) + "]"


DNA = Alphabet("dna", DNA_SYMBOLS, DNA_CODES, DNA_MEMBERS)
PROTEIN = Alphabet("protein", PROTEIN_SYMBOLS, PROTEIN_CODES, PROTEIN_MEMBERS)
BY_NAME = {"dna": DNA, "protein": PROTEIN}

DNA_WORD = f"^[{DNA_SYMBOLS}{DNA_CODES}-]*$"
PROTEIN_WORD = f"^[{PROTEIN_SYMBOLS}{PROTEIN_CODES}-]*$"


def detect(texts: list[str]) -> Alphabet:
    """DNA if every text is a DNA word, else protein."""
    return DNA if all(DNA.is_word(t) for t in texts) else PROTEIN


def normalised(residues: Column) -> Column:
    """Upper case, all gap signs as ``-``; null stays null."""
    return F.translate(F.upper(residues), "_*", "--")


def mask_of(alphabet: Alphabet, ch: Column) -> Column:
    """The mask of a one-letter column as a JVM-side map lookup; other letters stand for all symbols."""
    entries = {c: alphabet.mask(c) for c in alphabet.symbols + alphabet.codes + GAP}
    table = F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])
    return F.coalesce(F.element_at(table, ch), F.lit(alphabet.full_mask))


def set_size(mask: Column) -> Column:
    return F.bit_count(mask)
