"""The fixed schema of an index row, and graphs to and from it."""

from __future__ import annotations

from moiety.functions.graph import Atom, Bond, Graph, SGroup

ATOMS = "array<struct<z:int,h:int,charge:int,mass:int,radical:int,stereo:int,label:string>>"
BONDS = "array<struct<a:int,b:int,type:int,stereo:int,ra:int,rb:int>>"
SGROUPS = "array<struct<type:string,subtype:string,connectivity:string,atoms:array<int>,bonds:array<struct<a:int,b:int>>>>"
SIZES = "n_heavy int, n_hyd int, n_xbond int, n_hbond int"
SCHEMA = f"compound long, name string, atoms {ATOMS}, bonds {BONDS}, sgroups {SGROUPS}, {SIZES}, sub_bits array<int>, sub_size int, sim_levels array<array<int>>, sim_cum_0 int, sim_cum_1 int, sim_cum_2 int, sim_cum_3 int"
COLUMNS = [c.split()[0] for c in "compound name atoms bonds sgroups n_heavy n_hyd n_xbond n_hbond sub_bits sub_size sim_levels sim_cum_0 sim_cum_1 sim_cum_2 sim_cum_3".split()]


def to_graph(atoms: list[dict], bonds: list[dict], sgroups: list[dict] | None = None) -> Graph:
    return Graph(
        [Atom(a["z"], a["charge"] or 0, a["mass"] or 0, a["radical"] or 0, a["stereo"] or 0, a["label"] or "") for a in atoms],
        [Bond(b["a"], b["b"], b["type"], b["stereo"] or 0, refs=(b["ra"], b["rb"]) if b["ra"] is not None else None) for b in bonds],
        [SGroup(s["type"], s["subtype"], s["connectivity"], list(s["atoms"]), [(x["a"], x["b"]) for x in s["bonds"]]) for s in sgroups or ()],
    )


def from_graph(g: Graph) -> dict:
    near = g.neighbours()
    return {
        "atoms": [{"z": a.z, "h": sum(g.atoms[j].z == 1 for j in near[i]), "charge": a.charge, "mass": a.mass, "radical": a.radical, "stereo": a.stereo, "label": a.label} for i, a in enumerate(g.atoms)],
        "bonds": [{"a": b.a, "b": b.b, "type": b.type, "stereo": b.stereo, "ra": b.refs[0] if b.refs else None, "rb": b.refs[1] if b.refs else None} for b in g.bonds],
        "sgroups": [{"type": s.type, "subtype": s.subtype, "connectivity": s.connectivity, "atoms": s.atoms, "bonds": [{"a": x, "b": y} for x, y in s.bonds]} for s in g.sgroups],
    }
