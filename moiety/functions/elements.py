"""Elements, pseudo atoms, valences and common isotopes."""

from __future__ import annotations

SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {s: i + 1 for i, s in enumerate(SYMBOLS)}

#: Pseudo atoms have negative numbers.
R, Q, M, X, A, G, PS, ELECTRON, PHOTON, MU, ENZYME, ACP, EMPTY, UNKNOWN = range(-1, -15, -1)
_LETTERS = {"R": R, "Q": Q, "M": M, "X": X, "A": A, "G": G}
_NAMES = {"Ps": PS, "e": ELECTRON, "hv": PHOTON, "Mu": MU, "ACP": ACP, "Acp": ACP, "Enz": ENZYME, "": EMPTY}

#: Allowed valences, for implicit hydrogens.
VALENCES = {5: (3,), 6: (4,), 7: (3, 5), 8: (2,), 9: (1,), 14: (4,), 15: (3, 5), 16: (2, 4, 6), 17: (1,), 33: (3, 5), 34: (2, 4, 6), 35: (1,), 52: (2, 4, 6), 53: (1, 3, 5), 85: (1,)}

_COMMON = {1: 1, 2: 4, 3: 7, 4: 9, 5: 11, 6: 12, 7: 14, 8: 16, 9: 19, 10: 20, 11: 23, 12: 24, 13: 27, 14: 28, 15: 31, 16: 32, 17: 35, 18: 40, 19: 39, 20: 40, 26: 56, 29: 63, 30: 64, 33: 75, 34: 80, 35: 79, 47: 107, 50: 120, 53: 127, 78: 195, 79: 197, 80: 202, 82: 208}


def is_pseudo(z: int) -> bool:
    return z < 0


def is_metal(z: int) -> bool:
    return z in (3, 4) or 11 <= z <= 13 or 19 <= z <= 31 or 37 <= z <= 50 or 55 <= z <= 84 or z > 86


def is_halogen(z: int) -> bool:
    return z in (9, 17, 35, 53, 85)


def mass_difference(z: int, mass: int) -> int:
    """Mass number minus that of the most common isotope (0 where either is unknown)."""
    return mass - _COMMON[z] if mass and z in _COMMON else 0


def pseudo(label: str) -> tuple[int, str]:
    """Atom number of a label that is no element, and the label where it is unknown."""
    if label in _LETTERS:
        return _LETTERS[label], ""
    if label == "*" or label == "R#" or (len(label) == 2 and label[0] == "R" and label[1] in "123456789"):
        return R, ""
    if label[:1] == "G" and label[1:2] in ("*", "\\"):
        return G, ""
    if label in _NAMES:
        return _NAMES[label], ""
    return UNKNOWN, label
