"""64-bit FNV-1a in 32-bit halves, and the signed feature slots built on it.

Spark's long multiplication throws on overflow under ANSI rules, so a product with the prime
2^40 + 435 is formed from halves that stay below 2^63.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 0xCBF29CE484222325
#: Seed of adjacent pairs; single words have seed 0.
PAIR_SEED = 0x9E3779B9
_LOW = (1 << 32) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fnv1a(text: Column, seed: int = 0) -> Column:
    """FNV-1a of the UTF-8 bytes, the offset basis xored with the seed, as a signed long."""
    start = F.lit(_signed(OFFSET ^ seed)).cast("long")
    digits = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(digits, i * 2 - 1, 2), 16, 10).cast("long"))

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)
        first = low * F.lit(435)
        carried = high * F.lit(435) + F.shiftrightunsigned(first, 32) + F.shiftleft(low.bitwiseAND(F.lit((1 << 24) - 1)), 8)
        return F.shiftleft(carried.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(first.bitwiseAND(F.lit(_LOW)))

    return F.when(F.octet_length(text) > 0, F.aggregate(codes, start, step)).otherwise(start)


def slot(h: Column, dim: int) -> Column:
    """Unsigned remainder of a hash kept in a signed long."""
    wrap = (1 << 64) % dim
    return F.pmod(F.pmod(h, F.lit(dim)) + F.when(h < 0, wrap).otherwise(0), F.lit(dim)).cast("int")


def sign(h: Column) -> Column:
    """-1 when the top bit is set, else 1."""
    return F.when(h < 0, -1).otherwise(1)
