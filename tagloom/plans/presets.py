"""Named layouts, and what kinds of assay ask of the later steps."""

from __future__ import annotations

import re

from .layout import compile_layout, slices

#: Layouts of common protocols, (first read, second read).
PRESETS: dict[str, tuple[str, str | None]] = {
    "umi": ("^NNNNNNNN", None),
    "race": ("cagtggtatcaacgcagagtNNNNtNNNNtNNNN", None),
    "primerid": ("NNNNNNNNNcagtttaacttttgggccatcca", None),
    "duplex": ("^NNNNNNNNNNNN.....", "^NNNNNNNNNNNN....."),
    "10x": ("^XXXXXXXXXXXXXXXXNNNNNNNNNNNN", None),
    "10x-v2": ("^XXXXXXXXXXXXXXXXNNNNNNNNNN", None),
    "tso500": ("^NNNNN.....", None),
    "smarter-umi": ("^NNNNNNNNNN...", None),
}


#: What assays imply, as the options of matching and consensus; the layouts are presets, the first the usual one.
RECIPES = [
    # assay, other names, layouts, min_reads, pre_amp, use_payload, fast, contig
    ("airr", ("repseq", "rep-seq", "quasispecies"), ("race", "primerid"), 1, "rt", True, False, False),
    ("amplicon", ("targeted", "panel"), ("umi",), 2, "rt", False, False, False),
    ("exome", ("capture",), ("umi",), 2, "rt", False, False, False),
    ("ctdna", ("cfdna",), ("tso500", "duplex"), 3, "7.37e-5", False, False, False),
    ("mrd", (), ("race", "duplex"), 3, "rt", True, False, False),
    ("rnaseq", (), ("smarter-umi", "umi"), 1, "rt", False, True, False),
    ("10x-gex", ("10x", "gex"), ("10x",), 1, "rt", False, True, False),
    ("10x-vdj", ("vdj",), ("10x-v2", "10x"), 1, "rt", True, False, True),
]


def _named(name: str, known: dict[str, object], what: str) -> object:
    """The entry of that name, however it is written."""
    if (key := name.strip().lower()) not in known:
        raise ValueError(f"no {what} {name!r}; there are {', '.join(known)}")
    return known[key]


def preset(name: str) -> tuple[str, str | None]:
    return _named(name, PRESETS, "preset")


def recipe(name: str) -> dict[str, object]:
    """The options of matching and consensus that an assay, by any of its names, implies."""
    assay, _, (first, *also), *options = _named(name, {n: row for row in RECIPES for n in (row[0], *row[1])}, "assay")
    layout, slave = PRESETS[first]
    return {"assay": assay, "layout": layout, "slave": slave, "also": tuple(also)} | dict(zip(("min_reads", "pre_amp", "use_payload", "fast", "contig"), options))


def describe(sheet: list[dict[str, str | None]]) -> list[dict[str, object]]:
    """What each row of a sheet captures: lengths of layout, barcode (both mates') and cell. Broken layouts raise."""
    out = []
    for row in sheet:
        texts = [t and (slices(t) if ":" in t else t) for t in (row["pattern"], row.get("slave"))]
        try:
            master, slave = (compile_layout(t) if t else None for t in texts)
        except ValueError as e:
            raise ValueError(f"{row['sample']}: {e}") from None
        other = len(slave.places("umi")) if slave else 0
        out.append({"sample": row["sample"], "length": len(master.positions), "umi": len(master.places("umi")) + other, "slave_umi": other, "cell": len(master.places("cell"))})
    return out


def inline_sheet(pattern: str, sample: str, slave: str | None = None) -> list[dict[str, str | None]]:
    """A sheet of one row. A run of four C without a cell is refused: other tools write cells so, here C is a base."""
    if any(len(run) >= 4 for run in re.findall("C+", pattern)) and "X" not in pattern.upper():
        raise ValueError(f"layout {pattern!r}: C is a base here; a cell barcode is written X, as in {pattern.replace('C', 'X')!r}")
    sheet = [{"sample": sample, "pattern": pattern, "slave": slave, "r1": None, "r2": None}]
    describe(sheet)
    return sheet
