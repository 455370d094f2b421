"""Circular, subgraph, ring and atom fingerprints of graphs."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

from moiety.functions.graph import AROMATIC, Graph
from moiety.functions.hashing import feature, fold
from moiety.functions.normalize import cycles

GRAPH_SIZE, COUNT_LEVELS, RADIUS, RING_CAP = 7, 5, 3, 256


def circular(g: Graph, radius: int = RADIUS) -> list[list[int]]:
    """Sorted descriptors per radius 0..radius of all but hydrogen atoms.

    An atom's cover is the set of bonds that its descriptor has taken in. It gives a descriptor
    for a radius only if the cover changed; otherwise it drops out, for its neighbours too.
    """
    near = g.neighbours()
    live = {i: (a.z, frozenset()) for i, a in enumerate(g.atoms) if a.z != 1}
    levels = [sorted(h for h, _ in live.values())]
    for _ in range(radius):
        grown = {}
        for i, (h, cover) in live.items():
            around = [(k, *live[j]) for j, k in near[i].items() if j in live]
            wider = frozenset().union(*((frozenset((k,)) | c) for k, _, c in around)) if around else frozenset()
            if wider != cover:
                grown[i] = (feature(h, len(wider), [fold((g.bonds[k].type, x)) for k, x, _ in around]), wider)
        live = grown
        levels.append(sorted(h for h, _ in live.values()))
    return levels


def _usable(g: Graph) -> list[bool]:
    """Bonds between real heavy atoms that are no query bonds."""
    return [b.type <= AROMATIC and g.atoms[b.a].z > 1 and g.atoms[b.b].z > 1 for b in g.bonds]


def connected_subsets(g: Graph, least: int, most: int):
    """Every connected set of ``least``..``most`` usable bonds, once, as a tuple."""
    ok = _usable(g)
    touch: list[set[int]] = [set() for _ in g.bonds]
    at: dict[int, list[int]] = {}
    for k, b in enumerate(g.bonds):
        if ok[k]:
            at.setdefault(b.a, []).append(k)
            at.setdefault(b.b, []).append(k)
    for own in at.values():
        for k in own:
            touch[k].update(x for x in own if x != k)

    def extend(chosen: tuple[int, ...], frontier: list[int], seen: set[int]):
        if least <= len(chosen):
            yield chosen
        if len(chosen) == most:
            return
        frontier = list(frontier)
        while frontier:
            k = frontier.pop()
            fresh = [x for x in touch[k] if x not in seen]
            yield from extend((*chosen, k), frontier + fresh, seen | set(fresh))

    done: set[int] = set()
    for k in range(len(g.bonds)):
        if ok[k]:
            first = [x for x in touch[k] if x not in done]
            yield from extend((k,), first, done | {k} | set(first))
            done = done | {k}


@lru_cache(maxsize=1 << 18)
def _folded(z: int, kind: int, under: tuple[int, ...]) -> int:
    """``feature``, remembered: the branches of neighbouring subsets are mostly the same."""
    return feature(z, kind, list(under))


#: Marks a bond that is folded from both of its ends.
_MIDDLE = 0x4D49


def subset_hash(g: Graph, chosen: tuple[int, ...]) -> int | None:
    """Hash of a connected bond set: leaves are folded inwards, a single ring by its least reading."""
    ties: dict[int, dict[int, int]] = {}
    for k in chosen:
        b = g.bonds[k]
        ties.setdefault(b.a, {})[b.b] = b.type
        ties.setdefault(b.b, {})[b.a] = b.type
    under: dict[int, tuple[int, ...]] = dict.fromkeys(ties, ())
    leaves = [i for i, n in ties.items() if len(n) == 1]
    while leaves:
        ends, then = set(leaves), []
        for i in leaves:
            (j, kind), = ties.pop(i).items()
            own = _folded(g.atoms[i].z, kind, under[i])
            if j in ends:  # two atoms are left
                return _folded(_MIDDLE, 0, tuple(sorted((own, _folded(g.atoms[j].z, kind, under[j])))))
            left = ties[j]
            del left[i]
            under[j] = tuple(sorted((*under[j], own)))
            if not left:
                return _folded(g.atoms[j].z, 0, under[j])
            if len(left) == 1:
                then.append(j)
        leaves = then
    if any(len(n) != 2 for n in ties.values()):
        return None
    start = next(iter(ties))
    ring, here, came = [], start, None
    while True:
        step = next(j for j in ties[here] if j != came) if came is not None else next(iter(ties[here]))
        ring += [_folded(g.atoms[here].z, 0, under[here]) & 0xFFFFFFFF, ties[here][step]]
        came, here = here, step
        if here == start:
            break
    n = len(ring)
    back = ring[::-1]
    return fold(min(min(x[r:] + x[:r] for r in range(n)) for x in (ring, back)))


def subgraphs(g: Graph, query: bool = False, cover: dict | None = None) -> Counter:
    """Counts of subset hashes; a query leaves out sizes below that of its smallest fragment."""
    least = 1
    if query:
        ok = _usable(g)
        up = list(range(len(g.atoms)))

        def root(x: int) -> int:
            while up[x] != x:
                x = up[x]
            return x

        for k, b in enumerate(g.bonds):
            if ok[k]:
                up[root(b.a)] = root(b.b)
        sizes = Counter(root(b.a) for k, b in enumerate(g.bonds) if ok[k])
        least = min([GRAPH_SIZE, *sizes.values()])
    out: Counter = Counter()
    for chosen in connected_subsets(g, least, GRAPH_SIZE):
        h = subset_hash(g, chosen)
        if h is not None:
            out[h] += 1
            if cover is not None:
                cover.setdefault(h, set()).update(x for k in chosen for x in (g.bonds[k].a, g.bonds[k].b))
    return out


def rings(g: Graph, cover: dict | None = None, query: bool = False) -> Counter:
    """Simple rings by size, counted up to ``RING_CAP`` each (our stand-in for a pattern set).

    Where the search for rings of a size was cut off, a target counts ``RING_CAP`` of them and a query
    none, so that screening never loses a match.
    """
    out: Counter = Counter()
    for size in range(3, 8):
        every = cycles(g, size, 4 * RING_CAP)
        whole, found = len(every) < 4 * RING_CAP, [c for c in every if len(c) == size]
        if not whole if query else whole and not found:
            continue
        out[size] = min(RING_CAP, len(found)) if whole else RING_CAP
        if cover is not None:
            cover.setdefault(size, set()).update(x for c in found for x in c)
    return Counter({size: n for size, n in out.items() if n})


def elements(g: Graph, cover: dict | None = None) -> Counter:
    out: Counter = Counter()
    for i, a in enumerate(g.atoms):
        if a.z > 1:
            out[a.z] += 1
            if cover is not None:
                cover.setdefault(a.z, set()).add(i)
    return out


def substructure_bits(g: Graph, query: bool = False, cover: dict[int, set[int]] | None = None) -> set[int]:
    """Bits (kind, log count, feature): a target has all levels up to its count's, a query the top one."""
    out: set[int] = set()
    for kind, count in ((1, lambda c: subgraphs(g, query, c)), (2, lambda c: rings(g, c, query)), (3, lambda c: elements(g, c))):
        own: dict | None = {} if cover is not None else None
        for h, n in count(own).items():
            top = min(n.bit_length() - 1, COUNT_LEVELS - 1)
            for level in (top,) if query else range(top + 1):
                bit = fold((kind, level, h))
                out.add(bit)
                if cover is not None:
                    cover.setdefault(bit, set()).update(own[h])
    return out


def shared(a: list[list[int]], b: list[list[int]]) -> int:
    """Common members of two levelled multisets, with multiplicity."""
    return sum((Counter(x) & Counter(y)).total() for x, y in zip(a, b))
