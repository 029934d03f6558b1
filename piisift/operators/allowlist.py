"""V4 with an allow-list given as a table of any size: filters inside the row expression, exact by a cascade.

The distinct ``(type, value)`` keys of the corpus (thin rows) meet the list in
one join.  A Bloom filter over those that are listed is made by one aggregation
and tested in the row expression, so a text never moves for its allow-list, and
entries that are in no text cost no more than that join.  A second filter over
the other keys of the corpus that the first one lets through takes them out
again, a third one puts back listed keys that the second one caught, and so on
until none is wrong.  A filter grows with its keys, so each level is smaller by
its error rate, and more than a few levels are rare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.config import ALLOWLIST_KINDS
from piisift.functions.bloom import bloom_filter, passes
from piisift.session import checkpoint_dir

KEY = ["ptype", "value"]


def typed_allowlist(allow: DataFrame) -> DataFrame:
    """``(kind, value)`` -> distinct ``(ptype, value)`` of the kinds that apply; rows with a null are no entries."""
    kinds = F.create_map(*[x for k, t in ALLOWLIST_KINDS.items() for x in (F.lit(k), F.lit(t))])
    typed = allow.select(F.try_element_at(kinds, F.col("kind")).alias("ptype"), F.col("value").cast("string").alias("value"))
    return typed.where(F.col("ptype").isNotNull() & F.col("value").isNotNull()).distinct()


#: What a test of keys is for: a column made with ``test(ptype, value)``.
Use = Callable[[Callable[[Column, Column], Column]], Column]


def membership(keys: DataFrame, allow: DataFrame) -> Callable[[Use], Column]:
    """``listed(use)`` with ``use(test)``: exact membership in the list, for the keys in ``keys`` (the corpus' candidates).

    ``keys`` are ``(ptype, value)`` rows, repeated as they come, combined by
    key before they are exchanged.  Keys with a null are in no list.  The
    driver holds one filter per level.
    """
    checkpoint_dir(keys.sparkSession)
    filters: list[bytes] = []

    def add_filter(rows: DataFrame) -> None:
        filters.append(bloom_filter(rows, KEY, len(filters), rows.count()))

    def held(rows: DataFrame) -> DataFrame:
        """The rows that the newest filter lets through."""
        return rows.where(passes(filters[-1], len(filters) - 1, lambda test: test(F.col("ptype"), F.col("value")))).checkpoint(eager=True)

    entries = typed_allowlist(allow).withColumn("_listed", F.lit(True))
    known = keys.where(F.col("ptype").isNotNull() & F.col("value").isNotNull()).distinct().join(entries, KEY, "left").checkpoint(eager=True)
    right = known.where("_listed").select(*KEY)
    add_filter(right)
    wrong = held(known.where(F.col("_listed").isNull()).select(*KEY))
    while not wrong.isEmpty():
        add_filter(wrong)
        # the keys that the new filter should not hold, of those that every filter so far held
        wrong, right = held(right), wrong

    def use_from(level: int, use: Use) -> Column:
        """``use`` with the test that the filters from ``level`` on give together."""
        if level == len(filters):
            return use(lambda *key: F.lit(False))
        return passes(filters[level], level, lambda test: use_from(level + 1, lambda later: use(lambda *key: test(*key) & ~later(*key))))

    def null_is_not_listed(use: Use) -> Use:
        return lambda test: use(lambda *key: F.coalesce(test(*key), F.lit(False)) & key[0].isNotNull() & key[1].isNotNull())

    return lambda use: use_from(0, null_is_not_listed(use))
