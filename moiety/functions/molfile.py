"""Molfile readers: V2000, V3000, S-groups, and R-group query files; format dispatch."""

from __future__ import annotations

import itertools
import re

from moiety.functions import elements as E
from moiety.functions import smiles
from moiety.functions.graph import ANTICLOCKWISE, ANY, AROMATIC, CLOCKWISE, DOUBLE_OR_AROMATIC, OPPOSITE, SINGLE_OR_AROMATIC, SINGLE_OR_DOUBLE, TOGETHER, Atom, Bond, Graph, MoleculeError, SGroup

_TYPES = {1: 1, 2: 2, 3: 3, 4: AROMATIC, 5: SINGLE_OR_DOUBLE, 6: SINGLE_OR_AROMATIC, 7: DOUBLE_OR_AROMATIC, 8: ANY}
_CHARGES = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}


def _atom(symbol: str) -> Atom:
    if symbol in ("D", "T"):
        return Atom(1, mass=2 if symbol == "D" else 3, fixed_h=True)
    if symbol == "Mu-":
        return Atom(E.MU, charge=-1, fixed_h=True)
    if symbol in E.NUMBER:
        return Atom(E.NUMBER[symbol])
    z, label = E.pseudo(symbol)
    return Atom(z, label=label, fixed_h=True)


def _int(s: str) -> int:
    s = s.strip()
    try:
        return int(s) if s else 0
    except ValueError:
        raise MoleculeError(f"not a number in a molfile: {s!r}") from None


def _v2000(lines: list[str]) -> tuple[Graph, dict]:
    """Graph and extras (coordinates, wedges, R-group numbers, attachment points)."""
    head = lines[3] if len(lines) > 3 else ""
    na, nb = _int(head[0:3]), _int(head[3:6])
    if len(lines) < 4 + na + nb:
        raise MoleculeError("the molfile ends early")
    g, xyz, rgp, apo, wedge = Graph(name=lines[0].strip()), [], {}, {}, {}
    for s in lines[4 : 4 + na]:
        a = _atom(s[31:34].strip())
        xyz.append(tuple(float(s[k : k + 10] or 0) for k in (0, 10, 20)))
        if a.z > 0 and a.z in _MASS and (d := _int(s[34:36])):
            a.mass = _MASS[a.z] + d
        c = _int(s[36:39])
        a.charge = _CHARGES.get(c, a.charge)
        a.radical = 2 if c == 4 else 0
        valence = _int(s[48:51])
        a.label = a.label
        if valence:
            apo.setdefault("valence", {})[len(g.atoms)] = 0 if valence == 15 else valence
        g.atoms.append(a)
    for s in lines[4 + na : 4 + na + nb]:
        x, y, t, w = _int(s[0:3]) - 1, _int(s[3:6]) - 1, _int(s[6:9]), _int(s[9:12])
        if not (0 <= x < na and 0 <= y < na) or x == y:
            raise MoleculeError("a bond names an atom that isn't there")
        if t not in _TYPES:
            raise MoleculeError(f"unknown bond type {t}")
        if w:
            wedge[len(g.bonds)] = w
        g.bonds.append(Bond(x, y, _TYPES[t]))
    reset, groups = False, {}
    for s in lines[4 + na + nb :]:
        if s.startswith("M  END"):
            break
        kind, own = s[3:6], s[6:]
        if not s.startswith("M  "):
            continue
        pairs = [(_int(own[3 + 8 * k : 7 + 8 * k]) - 1, _int(own[7 + 8 * k : 11 + 8 * k])) for k in range(_int(own[0:3]))] if kind in ("CHG", "RAD", "ISO", "RGP", "APO") else []
        if kind in ("CHG", "RAD") and not reset:
            reset = True
            for a in g.atoms:
                a.charge, a.radical = 0, 0
        for i, v in pairs:
            if kind == "CHG":
                g.atoms[i].charge = v
            elif kind == "RAD":
                g.atoms[i].radical = v
            elif kind == "ISO":
                g.atoms[i].mass = v
            elif kind == "RGP":
                rgp[i] = v
            else:
                apo[i] = v
        w = own.split()
        if kind == "STY":
            for n, t in zip(w[1::2], w[2::2]):
                groups[n] = SGroup(t)
        elif kind in ("SST", "SCN"):
            for n, t in zip(w[1::2], w[2::2]):
                if n in groups:
                    setattr(groups[n], "subtype" if kind == "SST" else "connectivity", t)
        elif kind in ("SAL", "SBL") and w and w[0] in groups:
            for v in w[2:]:
                if kind == "SAL":
                    groups[w[0]].atoms.append(int(v) - 1)
                else:
                    b = g.bonds[int(v) - 1]
                    groups[w[0]].bonds.append((b.a, b.b))
    g.sgroups = list(groups.values())
    _geometry(g, xyz, wedge)
    _valences(g, apo.pop("valence", {}))
    return g, {"rgp": rgp, "apo": apo}


_MASS = {z: m for z, m in E._COMMON.items()}


def _valences(g: Graph, given: dict[int, int]) -> None:
    near = g.neighbours()
    for i, v in given.items():
        a = g.atoms[i]
        a.h = max(0, v - sum(t if t < AROMATIC else 1 for t in (g.bonds[k].type for k in near[i].values())))
        a.fixed_h = True


def _geometry(g: Graph, xyz: list[tuple[float, float, float]], wedge: dict[int, int]) -> None:
    """Senses of centres from wedges or three dimensions, and of double bonds from coordinates."""
    if len({p[:2] for p in xyz}) < 2:
        return
    near = g.neighbours()
    flat = all(abs(p[2]) < 1e-6 for p in xyz)
    for i, a in enumerate(g.atoms):
        own = sorted(near[i])
        if len(own) not in (3, 4):
            continue
        z = {j: xyz[j][2] - xyz[i][2] for j in own}
        if flat:
            z = {j: 0.0 for j in own}
            for j in own:
                k = near[i][j]
                if g.bonds[k].a == i and wedge.get(k) in (1, 6):
                    z[j] = 1.0 if wedge[k] == 1 else -1.0
            if not any(z.values()):
                continue
        v = [(xyz[j][0] - xyz[i][0], xyz[j][1] - xyz[i][1], z[j]) for j in own]
        if len(own) == 3:  # the missing neighbour lies away from the others
            v.append(tuple(-sum(c) for c in zip(*v)))
        p, q, r = (tuple(c - d for c, d in zip(v[k], v[0])) for k in (1, 2, 3))
        volume = p[0] * (q[1] * r[2] - q[2] * r[1]) - p[1] * (q[0] * r[2] - q[2] * r[0]) + p[2] * (q[0] * r[1] - q[1] * r[0])
        if abs(volume) > 1e-6:
            a.stereo = CLOCKWISE if volume < 0 else ANTICLOCKWISE
            a.order = own + [-1] * (len(own) == 3)
    for k, b in enumerate(g.bonds):
        if b.type != 2 or wedge.get(k) == 3:
            continue
        x, y = [j for j in near[b.a] if j != b.b], [j for j in near[b.b] if j != b.a]
        if not x or not y:
            continue
        side = [(xyz[b.b][0] - xyz[b.a][0]) * (xyz[m][1] - xyz[b.a][1]) - (xyz[b.b][1] - xyz[b.a][1]) * (xyz[m][0] - xyz[b.a][0]) for m in (min(x), min(y))]
        if abs(side[0]) > 1e-4 and abs(side[1]) > 1e-4:
            b.stereo, b.refs = (TOGETHER if (side[0] > 0) == (side[1] > 0) else OPPOSITE), (min(x), min(y))


def _v3000(text: str) -> Graph:
    lines, joined = [], ""
    for s in text.splitlines():
        if s.startswith("M  V30 "):
            joined += s[7:].rstrip("-") if s.endswith("-") else s[7:]
            if not s.endswith("-"):
                lines.append(joined.strip())
                joined = ""
    g, number, bond_no, xyz, wedge, part, groups = Graph(name=text.splitlines()[0].strip() if text else ""), {}, {}, [], {}, "", []
    valence: dict[int, int] = {}
    for s in lines:
        w = s.split()
        if s.startswith("BEGIN") or s.startswith("END"):
            part = w[1] if w[0] == "BEGIN" else ""
            continue
        more = dict(x.split("=", 1) for x in w if "=" in x and "(" not in x)
        if part == "ATOM":
            a = _atom(w[1])
            a.charge, a.radical, a.mass = int(more.get("CHG", a.charge)), int(more.get("RAD", 0)), int(more.get("MASS", a.mass))
            number[w[0]] = len(g.atoms)
            if "VAL" in more:
                valence[len(g.atoms)] = max(0, int(more["VAL"]))
            xyz.append((float(w[2]), float(w[3]), float(w[4])))
            g.atoms.append(a)
        elif part == "BOND":
            t = int(w[1])
            if t not in _TYPES or w[2] not in number or w[3] not in number:
                raise MoleculeError("cannot read a bond")
            bond_no[w[0]] = len(g.bonds)
            if more.get("CFG", "0") != "0":
                wedge[len(g.bonds)] = {"1": 1, "2": 3, "3": 6}.get(more["CFG"], 0)
            g.bonds.append(Bond(number[w[2]], number[w[3]], _TYPES[t]))
        elif part == "SGROUP" and len(w) > 1:
            lists = {k: v.split()[1:] for k, v in re.findall(r"(\w+)=\(([^)]*)\)", s)}
            groups.append(SGroup(w[1], more.get("SUBTYPE", ""), more.get("CONNECT", ""), [number[x] for x in lists.get("ATOMS", ()) if x in number], [(g.bonds[bond_no[x]].a, g.bonds[bond_no[x]].b) for x in lists.get("XBONDS", ()) if x in bond_no]))
    if not g.atoms and "COUNTS" not in text:
        raise MoleculeError("no atoms in a V3000 file")
    g.sgroups = groups
    _geometry(g, xyz, wedge)
    _valences(g, valence)
    return g


def parse_molfile(text: str) -> Graph:
    if "M  V30 BEGIN CTAB" in text:
        return _v3000(text)
    return _v2000(text.split("\n"))[0]


def parse_rgroups(text: str) -> list[Graph]:
    """All configurations of an R-group query file: each R atom takes each member of its group.

    Groups flagged "rest H" mark the root atoms at which no other heavy neighbour may stand.
    """
    root, rest_h = None, set()
    members: dict[int, list[tuple[Graph, dict]]] = {}
    for block in re.split(r"^\$(?=CTAB|RGP|END)", text, flags=re.M):
        lines = block.split("\n")
        if lines[0].startswith("CTAB"):
            got = _v2000(lines[1:])
            for s in lines:
                if s.startswith("M  LOG"):
                    w = s.split()[2:]
                    for k in range(1, len(w) - 2, 4):
                        if w[k + 2] == "1":
                            rest_h.add(int(w[k]))
            if root is None:
                root = got
            else:
                members.setdefault(current, []).append(got)
        elif lines[0].startswith("RGP") and len(lines) > 1:
            current = int(lines[1].strip() or 0)
    if root is None:
        raise MoleculeError("an R-group file without a root")
    sites = sorted(root[1]["rgp"].items())
    out = []
    for pick in itertools.product(*[members.get(r, [None]) for _, r in sites]):
        g = root[0].copy()
        gone = set()
        for (site, r), member in zip(sites, pick):
            if member is None:
                continue
            m, extra = member
            base = len(g.atoms)
            g.atoms += m.copy().atoms
            g.bonds += [Bond(b.a + base, b.b + base, b.type) for b in m.bonds]
            points = sorted(extra["apo"]) or [0]
            arms = [b for b in g.bonds if site in (b.a, b.b)]
            for n, b in enumerate(arms):
                other = b.a if b.b == site else b.b
                b.a, b.b = other, base + points[min(n, len(points) - 1)]
                if r in rest_h:
                    g.atoms[other].rest_h = True
            gone.add(site)
        out.append(_without(g, gone))
    return out


def _without(g: Graph, gone: set[int]) -> Graph:
    keep = [i for i in range(len(g.atoms)) if i not in gone]
    to = {old: new for new, old in enumerate(keep)}
    return Graph([g.atoms[i] for i in keep], [Bond(to[b.a], to[b.b], b.type) for b in g.bonds if b.a in to and b.b in to], name=g.name)


def read(text: str) -> Graph:
    """A database structure: a molfile if it has more than one line, else a SMILES."""
    if text is None:
        raise MoleculeError("no structure")
    return parse_molfile(text) if "\n" in text.strip("\n") else smiles.parse(text)


def read_query(text: str) -> list[Graph]:
    """A query: R-group file, molfile or SMILES; R-group files give several graphs."""
    if text.startswith("$MDL"):
        return parse_rgroups(text)
    return [read(text)]
