"""Labelled graphs: what every format becomes."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Bond types: 0 none, 1..6 orders, then aromatic and the query bonds.
AROMATIC, SINGLE_OR_DOUBLE, SINGLE_OR_AROMATIC, DOUBLE_OR_AROMATIC, ANY = 11, 12, 13, 14, 15
#: Atom stereo and bond stereo: none, one sense, the other, undefined.
NONE, CLOCKWISE, ANTICLOCKWISE, UNDEFINED = 0, 1, 2, 3
OPPOSITE, TOGETHER = 1, 2
MAX_IDS, MAX_VALENCE = 4095, 16


class MoleculeError(ValueError):
    """A structure that cannot be read or stored."""


@dataclass
class Atom:
    z: int
    charge: int = 0
    mass: int = 0
    radical: int = 0
    stereo: int = NONE
    label: str = ""
    h: int = 0  # hydrogens that are not atoms of the graph
    aromatic: bool = False  # as written
    fixed_h: bool = False  # ``h`` was given, not derived
    order: list[int] | None = None  # neighbours in the order that ``stereo`` refers to; -1 is an implicit hydrogen
    rest_h: bool = False


@dataclass
class Bond:
    a: int
    b: int
    type: int
    stereo: int = NONE
    mark: str = ""  # / or \ as written, from a to b
    refs: tuple[int, int] | None = None  # the neighbours that ``stereo`` relates


@dataclass
class SGroup:
    type: str
    subtype: str = ""
    connectivity: str = ""
    atoms: list[int] = field(default_factory=list)
    bonds: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Graph:
    atoms: list[Atom] = field(default_factory=list)
    bonds: list[Bond] = field(default_factory=list)
    sgroups: list[SGroup] = field(default_factory=list)
    name: str = ""

    def neighbours(self) -> list[dict[int, int]]:
        """Per atom: neighbour to bond number."""
        out: list[dict[int, int]] = [{} for _ in self.atoms]
        for k, b in enumerate(self.bonds):
            out[b.a][b.b] = k
            out[b.b][b.a] = k
        return out

    def copy(self) -> Graph:
        return Graph([Atom(**{**a.__dict__, "order": list(a.order) if a.order is not None else None}) for a in self.atoms], [Bond(**b.__dict__) for b in self.bonds], [SGroup(g.type, g.subtype, g.connectivity, list(g.atoms), list(g.bonds)) for g in self.sgroups], self.name)

    def renumbered(self, order: list[int]) -> Graph:
        """The graph whose atom i is atom ``order[i]`` here."""
        to = {old: new for new, old in enumerate(order)}
        out = self.copy()
        out.atoms = [out.atoms[i] for i in order]
        for a in out.atoms:
            if a.order is not None:
                a.order = [to[i] if i >= 0 else -1 for i in a.order]
        for b in out.bonds:
            b.a, b.b = to[b.a], to[b.b]
            if b.refs is not None:
                b.refs = (to[b.refs[0]] if b.refs[0] >= 0 else -1, to[b.refs[1]] if b.refs[1] >= 0 else -1)
        for g in out.sgroups:
            g.atoms = [to[i] for i in g.atoms]
            g.bonds = [(to[x], to[y]) for x, y in g.bonds]
        return out

    def sorted(self) -> Graph:
        """Rare elements first, then carbon, then hydrogen; more bonded atoms first within an element."""
        count: dict[int, int] = {}
        for a in self.atoms:
            count[a.z] = count.get(a.z, 0) + 1
        degree = [0] * len(self.atoms)
        for b in self.bonds:
            if self.atoms[b.a].z != 1 and self.atoms[b.b].z != 1:
                degree[b.a] += 1
                degree[b.b] += 1
        rank = lambda i: ({6: 1, 1: 2}.get(self.atoms[i].z, 0), count[self.atoms[i].z], -degree[i])
        return self.renumbered(sorted(range(len(self.atoms)), key=rank))

    def with_hydrogens(self) -> Graph:
        """Implicit hydrogens as atoms at the end."""
        out = self.copy()
        for i in range(len(self.atoms)):
            a = out.atoms[i]
            for _ in range(a.h):
                out.bonds.append(Bond(i, len(out.atoms), 1))
                out.atoms.append(Atom(1))
            if a.order is not None and -1 in a.order and a.h == 1:
                a.order[a.order.index(-1)] = len(out.atoms) - 1
            a.h = 0
        return out

    def checked(self) -> Graph:
        if len(self.atoms) > MAX_IDS or len(self.bonds) > MAX_IDS:
            raise MoleculeError("molecule is too big")
        for i, n in enumerate(self.neighbours()):
            if len(n) + self.atoms[i].h > MAX_VALENCE:
                raise MoleculeError("valence of an atom is too high")
            m = self.atoms[i].mass
            if m and self.atoms[i].z > 0 and not 1 <= m - self.atoms[i].z + 1 <= 256:
                raise MoleculeError("isotope is out of range")
        return self

    def fragments(self) -> list[list[int]]:
        near, seen, out = self.neighbours(), set(), []
        for i in range(len(self.atoms)):
            if i in seen:
                continue
            seen.add(i)
            todo, own = [i], []
            while todo:
                x = todo.pop()
                own.append(x)
                for y in near[x]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            out.append(sorted(own))
        return out


def parity(order: list[int]) -> int:
    """0 for an even permutation of sorted distinct values, 1 for an odd one."""
    return sum(x > y for i, x in enumerate(order) for y in order[i + 1 :]) % 2
