"""Database structures and query variants from text."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from moiety.functions import fingerprints, molfile
from moiety.functions.graph import NONE, Graph, MoleculeError
from moiety.functions.matching import Modes, Query, needs_hydrogens
from moiety.functions.normalize import apply_aromaticity, implicit_hydrogens, kekulize, perceive_stereo
from moiety.functions.tautomer import tautomers

MODES = {
    "search": ("SUBSTRUCTURE", "EXACT"),
    "charge": ("IGNORE", "DEFAULT_AS_UNCHARGED", "DEFAULT_AS_ANY"),
    "isotope": ("IGNORE", "DEFAULT_AS_STANDARD", "DEFAULT_AS_ANY"),
    "radical": ("IGNORE", "DEFAULT_AS_STANDARD", "DEFAULT_AS_ANY"),
    "stereo": ("IGNORE", "STRICT"),
    "aromaticity": ("PRESERVE", "DETECT", "AUTO"),
    "tautomer": ("IGNORE", "INCHI"),
}


def checked_mode(name: str, value: str) -> str:
    if value not in MODES[name]:
        raise ValueError(f"{name} must be one of {', '.join(MODES[name])}, not {value!r}")
    return value


def _plain(g: Graph) -> None:
    for a in g.atoms:
        a.stereo, a.order = NONE, None
    for b in g.bonds:
        b.stereo, b.refs = NONE, None


def stored(text: str) -> tuple[Graph, str | None]:
    """The graph to index (all hydrogens as atoms, rare elements first), and a warning if stereo failed."""
    g = molfile.read(text)
    implicit_hydrogens(g)
    apply_aromaticity(g, "AUTO")
    g = g.with_hydrogens().sorted().checked()
    try:
        perceive_stereo(g)
    except (ArithmeticError, LookupError, ValueError) as e:
        _plain(g)
        return g, f"stereo is left out: {e}"
    return g, None


@dataclass
class Variant:
    """One graph of a query, ready to match, with its screening bits and the atoms each covers."""

    graph: Graph
    query: Query
    bits: set[int]
    cover: dict[int, set[int]] = field(default_factory=dict)


def variants(text: str, modes: Modes = Modes(), aromaticity: str = "AUTO", tautomer: str = "IGNORE", similarity: bool = False) -> list[Variant]:
    """Query graphs: R-group configurations, then tautomers where they are asked for."""
    checked_mode("aromaticity", aromaticity)
    checked_mode("tautomer", tautomer)
    for k in ("search", "charge", "isotope", "radical", "stereo"):
        checked_mode(k, getattr(modes, k))
    out: list[Variant] = []
    for g in molfile.read_query(text):
        implicit_hydrogens(g)
        forms = [g]
        if tautomer == "INCHI":
            try:
                forms = _tautomer_forms(g)
            except MoleculeError as e:
                warnings.warn(f"tautomers are left out: {e}", stacklevel=2)
        for f in forms:
            f = f.copy()
            apply_aromaticity(f, aromaticity)
            if modes.exact or similarity:
                f = f.with_hydrogens()
            f = f.sorted()
            m = modes
            if modes.stereo == "STRICT":
                try:
                    perceive_stereo(f)
                except (ArithmeticError, LookupError, ValueError) as e:
                    warnings.warn(f"stereo and tautomers are left out: {e}", stacklevel=2)
                    return variants(text, Modes(modes.search, modes.charge, modes.isotope, modes.radical, "IGNORE"), aromaticity, "IGNORE", similarity)
            else:
                _plain(f)
            cover: dict[int, set[int]] = {}
            bits = fingerprints.substructure_bits(f, query=True, cover=cover)
            out.append(Variant(f, Query(f, m), bits, cover))
    return out


def _tautomer_forms(g: Graph) -> list[Graph]:
    k = g.copy()
    orders = kekulize(k)
    if orders is None:
        raise MoleculeError("no Kekulé form")
    for b, t in orders.items():
        k.bonds[b].type = t
    return [g, *tautomers(k)[1:]]


def levels_of(text: str, radius: int, aromaticity: str = "AUTO", tautomer: str = "IGNORE") -> list[list[list[int]]]:
    """Circular descriptors of each variant of a similarity query."""
    m = Modes(charge="DEFAULT_AS_UNCHARGED", isotope="DEFAULT_AS_STANDARD", radical="DEFAULT_AS_STANDARD")
    return [fingerprints.circular(v.graph, radius) for v in variants(text, m, aromaticity, tautomer, similarity=True)]


def pair_similarity(a: str, b: str, radius: int = 1, aromaticity: str = "AUTO") -> float:
    """Multiset Tanimoto over levels below ``radius`` (so radius 1 compares atoms only); NaN for nothing."""
    def levels(text: str) -> list[list[int]]:
        g = molfile.read(text)
        implicit_hydrogens(g)
        apply_aromaticity(g, checked_mode("aromaticity", aromaticity))
        return fingerprints.circular(g, max(0, radius - 1))[: max(0, radius)]

    x, y = levels(a), levels(b)
    common = fingerprints.shared(x, y)
    total = sum(map(len, x)) + sum(map(len, y)) - common
    return common / total if total else float("nan")


__all__ = ["MODES", "Variant", "checked_mode", "levels_of", "needs_hydrogens", "pair_similarity", "stored", "variants"]
