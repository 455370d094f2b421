"""Parsers, hashes, fingerprints and the matcher, against hand-derived values and brute force."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moiety.functions import fingerprints, hashing, molfile, smiles
from moiety.functions.graph import ANY, Atom, Bond, Graph, MoleculeError
from moiety.functions.matching import LimitExceeded, Modes, Query, all_matches, brute_force, score, sizes
from moiety.functions.structures import checked_mode, pair_similarity, stored, variants


def test_hash_values():
    assert hashing.fold((0, 0)) == -845889570
    assert hashing.fold((1, 6)) == 1110579283
    assert hashing.fold((1, 0, 6)) == 98715844


def test_circular_levels_by_hand():
    g, _ = stored("CCO")
    assert fingerprints.circular(g) == [[6, 6, 8], [-1101522095, -204124004, 1964673381], [-1251257815, 765066170], [-1222359778, 1831469423]]
    assert fingerprints.circular(stored("CCN")[0], 1) == [[6, 6, 7], [838891565, 1272394089, 1964673381]]


def hit(query, target, aromaticity="AUTO", tautomer="IGNORE", **modes):
    t, _ = stored(target)
    for v in variants(query, Modes(**modes), aromaticity, tautomer):
        if v.query.matches(t):
            return score(v.query.sizes, sizes(t))
    return None


def test_scores_by_hand():
    assert hit("CO", "CCO") == pytest.approx((8 * 2 / 3 + 4 / 2) / 15)
    assert hit("OCC", "CCO", search="EXACT") == 1.0
    assert hit("CC", "CCO", search="EXACT") is None


@pytest.mark.parametrize(
    ("query", "target", "modes", "found"),
    [
        ("c1ccccc1", "OC1=CC=CC=C1", {}, True),
        ("C1=CC=CC=C1", "c1ccccc1O", {}, True),
        ("[H]OC", "CCO", {}, True),
        ("[H]OC", "COC", {}, False),
        ("[X]C", "CCl", {}, True),
        ("[X]C", "CO", {}, False),
        ("[Q]C", "CO", {}, True),
        ("[M]", "[Na+].[Cl-]", {"charge": "IGNORE"}, True),
        ("C[N+]", "CN", {}, False),
        ("CN", "C[N+](C)(C)C", {}, True),
        ("CN", "C[N+](C)(C)C", {"charge": "DEFAULT_AS_UNCHARGED"}, False),
        ("C[N+]", "CN", {"charge": "IGNORE"}, True),
        ("[13C]", "C", {"isotope": "IGNORE"}, True),
        ("[13C]", "C", {"isotope": "DEFAULT_AS_ANY"}, False),
        ("C", "[13CH4]", {"isotope": "DEFAULT_AS_STANDARD"}, False),
        ("N[C@@H](C)C(=O)O", "OC(=O)[C@H](C)N", {"stereo": "STRICT"}, True),
        ("N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O", {"stereo": "STRICT"}, False),
        ("N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O", {}, True),
        ("F/C=C/F", "F\\C=C\\F", {"stereo": "STRICT"}, True),
        ("F/C=C/F", "F/C=C\\F", {"stereo": "STRICT"}, False),
        ("F/C=C/F", "FC=CF", {"stereo": "STRICT"}, True),
        ("F/C=C/F", "FC=CF", {"stereo": "STRICT", "search": "EXACT"}, False),
    ],
)
def test_modes(query, target, modes, found):
    assert (hit(query, target, **modes) is not None) is found


def test_tautomers():
    assert hit("CC(O)=C", "CC(C)=O", search="EXACT") is None
    assert hit("CC(O)=C", "CC(C)=O", search="EXACT", tautomer="INCHI") == 1.0


def test_pair_similarity():
    assert pair_similarity("CCO", "CCN") == 0.5
    assert pair_similarity("CCO", "CCN", 2) == pytest.approx(1 / 3)
    assert math.isnan(pair_similarity("CCO", "CCN", 0))
    assert pair_similarity("OCC", "CCO", 4) == 1.0


@pytest.mark.parametrize("bad", ["", "C(", "C1CC", "C)", "[Zz]", "[C", "C#%", "1CC", "not a molecule("])
def test_unreadable(bad):
    with pytest.raises((MoleculeError, ValueError)):
        smiles.parse(bad)


def test_unknown_mode():
    with pytest.raises(ValueError):
        checked_mode("stereo", "MAYBE")


ETHANOL = "ethanol\n\n\n  3  2  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 C   0  0\n    1.0000    0.0000    0.0000 C   0  0\n    2.0000    0.0000    0.0000 O   0  0\n  1  2  1  0\n  2  3  1  0\nM  END\n"
ETHANOL_V3 = "x\n\n\n  0  0  0     0  0            999 V3000\nM  V30 BEGIN CTAB\nM  V30 COUNTS 3 2 0 0 0\nM  V30 BEGIN ATOM\nM  V30 1 C 0 0 0 0\nM  V30 2 C 1 0 0 0\nM  V30 3 O 2 0 0 0\nM  V30 END ATOM\nM  V30 BEGIN BOND\nM  V30 1 1 1 2\nM  V30 2 1 2 3\nM  V30 END BOND\nM  V30 END CTAB\nM  END\n"


@pytest.mark.parametrize("text", [ETHANOL, ETHANOL_V3])
def test_molfiles(text):
    assert fingerprints.circular(stored(text)[0]) == fingerprints.circular(stored("CCO")[0])


def test_molfile_properties():
    text = ETHANOL.replace("M  END", "M  CHG  1   3  -1\nM  ISO  1   1  13\nM  RAD  1   2   2\nM  END")
    g = molfile.parse_molfile(text)
    assert [a.charge for a in g.atoms] == [0, 0, -1] and g.atoms[0].mass == 13 and g.atoms[1].radical == 2


def test_query_bonds():
    single_or_double = ETHANOL.replace("  2  3  1  0", "  2  3  5  0")
    assert hit(single_or_double, "CCO") and hit(single_or_double, "CC=O") and not hit(single_or_double, "CC#N")


def test_rgroup_configurations():
    root = ETHANOL.replace(" O   0  0", " R#  0  0").replace("M  END", "M  RGP  1   3   1\nM  END")
    member = "\n\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 {}   0  0\nM  APO  1   1   1\nM  END\n"
    text = "$MDL  REV  1\n$MOL\n$HDR\n\n\n\n$END HDR\n$CTAB\n" + root + "$END CTAB\n$RGP\n   1\n$CTAB\n" + member.format("O") + "$END CTAB\n$CTAB\n" + member.format("N") + "$END CTAB\n$END RGP\n$END MOL\n"
    found = molfile.read_query(text)
    assert sorted(sorted(a.z for a in g.atoms) for g in found) == [[6, 6, 7], [6, 6, 8]]
    assert hit(text, "CCO") and hit(text, "CCN") and not hit(text, "CCS")


def shuffled(g, seed):
    order = list(range(len(g.atoms)))
    random.Random(seed).shuffle(order)
    return g.renumbered(order)


@pytest.mark.parametrize("text", ["CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "C1CC2CCC1C2", "[Na+].[Cl-]"])
def test_fingerprints_ignore_atom_order(text):
    g, _ = stored(text)
    for seed in range(3):
        h = shuffled(g, seed)
        assert fingerprints.circular(h) == fingerprints.circular(g)
        assert fingerprints.substructure_bits(h) == fingerprints.substructure_bits(g)


def test_subsets_are_each_found_once():
    import itertools

    g, _ = stored("C1CC1CO")
    heavy = [k for k, b in enumerate(g.bonds) if g.atoms[b.a].z > 1 and g.atoms[b.b].z > 1]
    got = sorted(tuple(sorted(x)) for x in fingerprints.connected_subsets(g, 1, 4))

    def connected(bonds):
        left, seen = set(bonds), {g.bonds[bonds[0]].a}
        while more := [k for k in left if g.bonds[k].a in seen or g.bonds[k].b in seen]:
            for k in more:
                seen |= {g.bonds[k].a, g.bonds[k].b}
                left.discard(k)
        return not left

    want = sorted(c for n in range(1, 5) for c in itertools.combinations(heavy, n) if connected(c))
    assert got == want


@pytest.mark.parametrize(("query", "target"), [("CO", "CCO"), ("c1ccccc1", "CC(=O)Oc1ccccc1C(=O)O"), ("CCC", "C1CC2CCC1C2"), ("C1CC1", "C1CC1CO")])
def test_screening_bits_are_necessary(query, target):
    (v,) = variants(query)
    assert v.query.matches(stored(target)[0]) and v.bits <= fingerprints.substructure_bits(stored(target)[0])


graphs = st.integers(1, 5).flatmap(lambda n: st.tuples(st.lists(st.sampled_from([6, 7, 8]), min_size=n, max_size=n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.sampled_from([1, 2])), max_size=7)))


def build(x, query=False):
    z, bonds = x
    seen = {}
    for a, b, t in bonds:
        if a != b:
            seen.setdefault((min(a, b), max(a, b)), ANY if query and t == 2 else t)
    return Graph([Atom(v) for v in z], [Bond(a, b, t) for (a, b), t in seen.items()])


@settings(max_examples=150, deadline=None)
@given(graphs, graphs)
def test_matcher_equals_brute_force(q, t):
    q, t = build(q, True), build(t)
    assert Query(q).matches(t) == brute_force(q, t)
    exact = Modes(search="EXACT")
    if Query(q, exact).matches(t):
        assert Query(q).matches(t)


def test_limit_counts_pairs():
    t, _ = stored("CCCCO")
    (v,) = variants("CO")
    assert v.query.matches(t, 0)
    with pytest.raises(LimitExceeded):
        v.query.matches(t, 1)


def test_all_matches_are_distinct_atom_sets():
    q, t = Graph([Atom(6), Atom(6)], [Bond(0, 1, 1)]), Graph([Atom(6)] * 3, [Bond(0, 1, 1), Bond(1, 2, 1)])
    assert sorted(map(sorted, all_matches(q, t, 10))) == [[0, 1], [1, 2]]
    assert len(all_matches(q, t, 1)) == 1
