"""The barcode layout language, compiled to positions on the driver.

A layout is a string over IUPAC codes: upper case must match, lower case counts
half against a mismatch; N is a barcode (UMI) position, X a cell position, ``.`` is
skipped, and a leading ``^`` ties the layout to the start of the read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The IUPAC codes of base sets.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
MAX_CAPTURE = 32
SAFE_NAME = re.compile(r"(?!-)(?!.*\.\.)[^\x00-\x1f\x7f/\\]+")


@dataclass(frozen=True)
class Position:
    kind: str  # "scored", "umi", "cell" or "skip"
    bases: str = ""
    weight: float = 1.0


@dataclass(frozen=True)
class Layout:
    text: str
    positions: tuple[Position, ...]
    anchored: bool

    def places(self, kind: str) -> list[int]:
        return [i for i, p in enumerate(self.positions) if p.kind == kind]

    @property
    def positional(self) -> bool:
        """Nothing is scored, so only the chemistry places it."""
        return not self.places("scored")


def compile_layout(text: str) -> Layout:
    anchored = text.startswith("^")
    body = text[1:] if anchored else text
    if not body:
        raise ValueError("layout: empty")
    out = []
    for at, c in enumerate(body):
        if c in "Nn":
            out.append(Position("umi"))
        elif c in "Xx":
            out.append(Position("cell"))
        elif c == ".":
            out.append(Position("skip"))
        elif c.upper() in IUPAC:
            out.append(Position("scored", IUPAC[c.upper()], 1.0 if c.isupper() else 0.5))
        else:
            raise ValueError(f"layout {text!r}: unknown symbol {c!r} at {at + 1}")
    layout = Layout(text, tuple(out), anchored)
    umi, cell = len(layout.places("umi")), len(layout.places("cell"))
    if not umi + cell:
        raise ValueError(f"layout {text!r} captures nothing")
    if umi + cell > MAX_CAPTURE:
        raise ValueError(f"layout {text!r} captures {umi + cell} bases; at most {MAX_CAPTURE} fit")
    return layout


def slices(text: str) -> str:
    """``0:4,5:10`` or ``cell:0:16,16:26`` (half-open, increasing) as an anchored layout; gaps are skipped."""
    at, out = 0, []
    for part in text.split(","):
        fields = part.strip().split(":")
        kind = "N"
        if fields[0] in ("cell", "umi"):
            kind = "X" if fields.pop(0) == "cell" else "N"
        try:
            start, end = map(int, fields)
        except ValueError:
            raise ValueError(f"slice {part!r}: two numbers are needed") from None
        if start < at or end <= start:
            raise ValueError(f"slice {part!r}: slices must be increasing and not empty")
        out.append("." * (start - at) + kind * (end - start))
        at = end
    return "^" + "".join(out)


def read_structure(text: str) -> str:
    """``5M5S+T`` as an anchored layout: M barcode, B cell, S skipped, up to the template T."""
    out, rest = [], text
    while rest:
        found = re.match(r"(\d+|\+)([MBST])", rest)
        if not found:
            raise ValueError(f"read structure {text!r}: cannot read {rest!r}")
        n, kind = found.groups()
        if kind == "T":
            break
        if n == "+":
            raise ValueError(f"read structure {text!r}: only the template may have any length")
        out.append({"M": "N", "B": "X", "S": "."}[kind] * int(n))
        rest = rest[found.end() :]
    return "^" + "".join(out)


def max_offset(layouts: list[Layout]) -> int:
    """0 if all are tied to the start or positional, else -1 for a scan."""
    return 0 if all(x.anchored or x.positional for x in layouts) else -1


def check_name(name: str) -> str:
    """A sample's name that can be a file's: no separators, ``..``, leading ``-`` or control characters."""
    if not SAFE_NAME.fullmatch(name):
        raise ValueError(f"sample name {name!r} cannot be a file name")
    return name
