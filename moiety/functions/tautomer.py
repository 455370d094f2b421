"""Mobile-hydrogen tautomers: 1,3 shifts H-X-Y=Z to X=Y-Z-H, keto and enol forms among them.

A documented subset of what a full tautomer model covers; ``MOST`` forms at most, else an error.
"""

from __future__ import annotations

from moiety.functions.graph import Graph, MoleculeError

MOST = 1024
_ENDS = {6, 7, 8, 16, 34}


def _key(g: Graph) -> tuple:
    return tuple(a.h for a in g.atoms), tuple(b.type for b in g.bonds)


def tautomers(g: Graph) -> list[Graph]:
    """All forms reachable, the given one first. Orders must be Kekulé, hydrogens counted."""
    seen, out, at = {_key(g)}, [g], 0
    while at < len(out):
        form = out[at]
        at += 1
        near = form.neighbours()
        for k, bond in enumerate(form.bonds):
            if bond.type != 2:
                continue
            for y, z in ((bond.a, bond.b), (bond.b, bond.a)):
                for x, kx in near[y].items():
                    a, c = form.atoms[x], form.atoms[z]
                    if x == z or form.bonds[kx].type != 1 or not a.h or a.z not in _ENDS or c.z not in _ENDS or form.atoms[y].z not in (6, 7):
                        continue
                    if a.z == 6 and c.z == 6:  # carbon to carbon is no mobile hydrogen
                        continue
                    new = form.copy()
                    new.atoms[x].h -= 1
                    new.atoms[z].h += 1
                    new.bonds[kx].type, new.bonds[k].type = 2, 1
                    key = _key(new)
                    if key not in seen:
                        seen.add(key)
                        out.append(new)
                        if len(out) >= MOST:
                            raise MoleculeError("too many tautomers")
    return out
