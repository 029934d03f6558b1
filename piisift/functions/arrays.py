"""Array helpers built from Spark higher-order functions.

Inside a lambda Spark neither caches nor eliminates common subexpressions, and
an ``aggregate`` that appends to an array copies it at every step (quadratic in
the array length).  These helpers keep per-text work near-linear:

* :func:`let` evaluates a value once and binds it to a lambda variable;
* :func:`inclusive_scan` is a blocked prefix scan with a small, constant
  expression size and near-linear work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def inclusive_scan(arr: Column, op: Callable[[Column, Column], Column], zero: Column, block: int = 64) -> Column:
    """Prefix scan of ``arr`` with an associative ``op`` whose identity is ``zero``.

    Two-level blocking keeps the expression small: per-block totals (``O(k)``),
    a fold over the ``k / block`` totals for each block's offset
    (``O((k / block)^2)`` copying), and each element's sum within its block
    (``O(k * block)``).  For ``k`` up to a million that is a few times ``10^7``
    steps instead of the ``k^2 / 2`` of an appending fold.
    """

    def on_array(a: Column) -> Column:
        n = F.size(a)
        n_blocks = ((n + block - 1) / block).cast("int")

        def block_sum(j: Column) -> Column:
            return F.aggregate(F.slice(a, j * block + 1, block), zero, op)

        totals = F.transform(F.sequence(F.lit(0), n_blocks - 1), block_sum)

        def with_offsets(offsets: Column) -> Column:
            def element(x: Column, i: Column) -> Column:
                b = (i / block).cast("int")
                within = F.aggregate(F.slice(a, b * block + 1, i - b * block + 1), zero, op)
                return op(F.element_at(offsets, b + 1), within)

            return F.transform(a, element)

        # Exclusive prefix of the block totals: the offset of each block.
        return F.when(n == 0, a).otherwise(let(_exclusive(totals, op, zero), with_offsets))

    return let(arr, on_array)


def _exclusive(totals: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Exclusive prefix of a short array by an appending fold."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["run"], x).alias("run"), F.concat(acc["out"], F.array(acc["run"])).alias("out"))

    init = F.struct(zero.alias("run"), F.slice(F.array(zero), 1, 0).alias("out"))
    return F.aggregate(totals, init, step, lambda acc: acc["out"])
