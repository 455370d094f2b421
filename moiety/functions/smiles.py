"""SMILES reader: organic subset, brackets, branches, rings, aromatic atoms, charges, isotopes,
classes, dots, ``@``/``@@`` and ``/`` ``\\`` marks, ``*`` and query bonds ``~``."""

from __future__ import annotations

import re

from moiety.functions import elements as E
from moiety.functions.graph import ANY, ANTICLOCKWISE, AROMATIC, CLOCKWISE, Atom, Bond, Graph, MoleculeError

_BRACKET = re.compile(r"(\d+)?([A-Z][a-z]?|[a-z][a-z]?|\*)(@{0,2}(?:[A-Z]{2}\d+)?)(H\d*)?([+-]+\d*|\d*[+-])?(?::(\d+))?$")
_ORGANIC = re.compile(r"Cl|Br|[BCNOPSFI]|[bcnops]|\*")
_BOND = {"-": 1, "=": 2, "#": 3, "$": 4, ":": AROMATIC, "~": ANY, "/": 1, "\\": 1}
_AROMATIC = {"b", "c", "n", "o", "p", "s", "se", "as", "te"}


def parse(text: str) -> Graph:
    """The graph of a SMILES; a title after white space is ignored; raises MoleculeError."""
    parts = text.split()
    if not parts:
        raise MoleculeError("empty structure")
    s, g = parts[0], Graph(name=parts[0])
    stack: list[int] = []
    last, bond, mark, i = -1, None, "", 0
    rings: dict[int, tuple[int, int | None, str, int]] = {}
    order: list[list[int]] = []  # neighbours as written; -1 an implicit hydrogen; (-2 - ring) an open ring
    chiral: dict[int, str] = {}

    def link(a: int, b: int, kind: int | None, sign: str) -> None:
        if a == b:
            raise MoleculeError("a bond joins an atom with itself")
        if kind is None:
            kind = AROMATIC if g.atoms[a].aromatic and g.atoms[b].aromatic else 1
        if any({x.a, x.b} == {a, b} for x in g.bonds):
            raise MoleculeError("two bonds join the same atoms")
        g.bonds.append(Bond(a, b, kind, mark=sign))

    def add(atom: Atom, sense: str) -> None:
        nonlocal last, bond, mark
        g.atoms.append(atom)
        k = len(g.atoms) - 1
        order.append([])
        if last >= 0:
            link(last, k, bond, mark)
            order[last].append(k)
            order[k].append(last)
        if atom.fixed_h and atom.h:
            order[k] += [-1] * atom.h
        if sense:
            chiral[k] = sense
        last, bond, mark = k, None, ""

    while i < len(s):
        c = s[i]
        if c == "[":
            j = s.find("]", i)
            if j < 0:
                raise MoleculeError("a bracket is not closed")
            m = _BRACKET.match(s[i + 1 : j])
            if not m:
                raise MoleculeError(f"cannot read atom [{s[i + 1 : j]}]")
            mass, symbol, sense, hs, charge, _ = m.groups()
            low = symbol in _AROMATIC
            name = symbol.capitalize() if low else symbol
            z, label = (E.NUMBER[name], "") if name in E.NUMBER else E.pseudo(symbol)
            if z == E.UNKNOWN and symbol not in ("D", "T"):
                raise MoleculeError(f"unknown element {symbol}")
            iso = int(mass or 0)
            if symbol in ("D", "T"):
                z, label, iso = 1, "", 2 if symbol == "D" else 3
            q = 0
            if charge:
                digits = re.sub(r"[+-]", "", charge)
                q = (int(digits) if digits else charge.count("+") + charge.count("-")) * (1 if "+" in charge else -1)
            add(Atom(z, q, iso, label=label, h=int(hs[1:] or 1) if hs else 0, aromatic=low, fixed_h=True), sense)
            i = j + 1
        elif m := _ORGANIC.match(s, i):
            t = m.group()
            low = t in _AROMATIC
            add(Atom(E.R, fixed_h=True) if t == "*" else Atom(E.NUMBER[t.capitalize()], aromatic=low), "")
            i = m.end()
        elif c in _BOND:
            bond, mark = _BOND[c], c if c in "/\\" else ""
            i += 1
        elif c.isdigit() or c == "%":
            if c == "%":
                if s[i + 1 : i + 2] == "(":
                    j = s.find(")", i)
                    n, i = int(s[i + 2 : j]), j + 1
                else:
                    n, i = int(s[i + 1 : i + 3]), i + 3
            else:
                n, i = int(c), i + 1
            if last < 0:
                raise MoleculeError("a ring number has no atom")
            if n in rings:
                a, kind, sign, at = rings.pop(n)
                link(a, last, kind if kind is not None else bond, sign or {"/": "\\", "\\": "/"}.get(mark, ""))
                order[a][order[a].index(at)] = last
                order[last].append(a)
            else:
                at = -2 - len(g.bonds) - 1000 * n
                rings[n] = (last, bond, mark, at)
                order[last].append(at)
            bond, mark = None, ""
        elif c == "(":
            stack.append(last)
            i += 1
        elif c == ")":
            if not stack:
                raise MoleculeError("a branch is closed that isn't open")
            last, i = stack.pop(), i + 1
        elif c == ".":
            last, bond, mark, i = -1, None, "", i + 1
        else:
            raise MoleculeError(f"cannot read {c!r}")
    if rings or stack:
        raise MoleculeError("a ring or branch is not closed")
    for k, sense in chiral.items():
        if sense in ("@", "@@", "@TH1", "@TH2", "@AL1", "@AL2"):
            g.atoms[k].stereo = ANTICLOCKWISE if sense in ("@", "@TH1", "@AL1") else CLOCKWISE
            g.atoms[k].order = order[k]
    return g
