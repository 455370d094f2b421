"""The 32-bit feature hashes, as Python integers and as Spark columns."""

from __future__ import annotations

from collections.abc import Iterable

_MASK = 0xFFFFFFFF
_K, _C = 2654435761, 2654435769


def signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 32) if x >> 31 else x


def fold(values: Iterable[int], seed: int = 0) -> int:
    """Each value, as unsigned 32 bits, is mixed into the seed; a signed result."""
    for x in values:
        seed ^= ((x & _MASK) * _K + _C + (seed << 6) + (seed >> 2)) & _MASK
    return signed(seed)


def feature(first: int, second: int, rest: Iterable[int] = ()) -> int:
    """Two values, then the others in unsigned order."""
    return fold((first, second, *sorted(x & _MASK for x in rest)))


def mix_column(value, seed):
    """One step of ``fold`` on columns of non-negative longs below 2^32, without overflow."""
    from pyspark.sql import functions as F

    low, high = value.bitwiseAND(F.lit(0xFFFF)), F.shiftright(value, 16)
    product = low * F.lit(_K) + F.shiftleft((high * F.lit(_K)).bitwiseAND(F.lit(_MASK)), 16).bitwiseAND(F.lit(_MASK))
    return seed.bitwiseXOR((product + F.lit(_C) + F.shiftleft(seed, 6) + F.shiftright(seed, 2)).bitwiseAND(F.lit(_MASK)))


def fold_columns(*values):
    """``fold`` of columns of 32-bit integers (signed or unsigned), as a signed long."""
    from pyspark.sql import functions as F

    seed = F.lit(0).cast("long")
    for v in values:
        seed = mix_column(v.cast("long").bitwiseAND(F.lit(_MASK)), seed)
    return F.when(seed >= F.lit(1 << 31), seed - F.lit(1 << 32)).otherwise(seed)
