"""FNV-1a over token ids as Catalyst arithmetic: the 64-bit state is kept in two halves, as whole products overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a, 64 bits: the offset basis and the prime 2^40 + 0x1B3.
BASIS_HIGH, BASIS_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
_MASK = 0xFFFFFFFF


def fnv1a(ids: Column) -> Column:
    """{hi, lo} of the hash over the little-endian bytes of unsigned 32-bit ids."""
    shifts = F.array(*[F.lit(s) for s in (0, 8, 16, 24)])
    octets = F.flatten(F.transform(ids, lambda t: F.transform(shifts, lambda s: F.call_function("shiftright", t.cast("long"), s).bitwiseAND(F.lit(255)))))

    def step(state: Column, octet: Column) -> Column:
        low = state["lo"].bitwiseXOR(octet)
        carry = low * PRIME_LOW
        high = state["hi"] * PRIME_LOW + F.shiftright(carry, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_MASK)).alias("hi"), carry.bitwiseAND(F.lit(_MASK)).alias("lo"))

    return F.aggregate(octets, F.struct(F.lit(BASIS_HIGH).cast("long").alias("hi"), F.lit(BASIS_LOW).cast("long").alias("lo")), step)
