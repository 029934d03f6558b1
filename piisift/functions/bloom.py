"""Bloom filters sized by their keys: made by one aggregation, tested inside a row expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.functions.arrays import let

#: Fewest bits of a filter (1 MB), bits of one bitmap that the aggregation builds, and hashes (two places each) per key.
FILTER_BITS, BITMAP_BITS, HASHES = 1 << 23, 1 << 15, 3
#: Bits that a key has in a filter of more than the fewest, and the most bits that a place (32 bits of a hash) can tell apart.
KEY_BITS, MOST_BITS = 16, 1 << 32


def filter_bits(n_keys: int) -> int:
    """Bits of a filter of that many keys, a power of two: two to four bytes a key."""
    return min(MOST_BITS, max(FILTER_BITS, 1 << (n_keys * KEY_BITS - 1).bit_length()))


def _places(key: list[Column], level: int, bits: int) -> list[Column]:
    """The bits of a key: two places from each hash; levels are independent of each other."""
    low = F.lit(bits - 1).cast("long")
    hashes = [F.xxhash64(F.lit(level * HASHES + i), *key) for i in range(HASHES)]
    return [place for h in hashes for place in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32).bitwiseAND(low))]


def bloom_filter(keys: DataFrame, columns: list[str], level: int = 0, n_keys: int = 0) -> bytes:
    """The filter of all rows' keys: bitmaps of ``BITMAP_BITS`` bits, combined before and after one exchange.

    Sized for ``n_keys`` keys; the bitmaps, two to four bytes a key, reach the driver.
    """
    bits = filter_bits(n_keys)
    place = keys.select(F.explode(F.array(*_places([F.col(c) for c in columns], level, bits))).alias("p"))
    part = place.groupBy(F.floor(F.col("p") / BITMAP_BITS).cast("int").alias("part"))
    out = bytearray(bits // 8)
    for r in part.agg(F.bitmap_construct_agg(F.col("p") % BITMAP_BITS).alias("bits")).collect():
        out[r["part"] * BITMAP_BITS // 8 : (r["part"] + 1) * BITMAP_BITS // 8] = r["bits"]
    return bytes(out)


def passes(bits: bytes, level: int, keys: Callable[[Callable[..., Column]], Column]) -> Column:
    """``keys(test)`` with ``test(*key)``: whether a key may be in the filter; no key that is in it fails.

    The filter is bound once, however often ``keys`` tests.
    """

    def with_filter(held: Column) -> Column:
        def test(*key: Column) -> Column:
            out = F.lit(True)
            for place in _places(list(key), level, 8 * len(bits)):
                byte = F.conv(F.hex(F.substring(held, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
                out = out & (F.call_function("getbit", byte, place.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1)
            return out

        return keys(test)

    return let(F.lit(bits), with_filter)
