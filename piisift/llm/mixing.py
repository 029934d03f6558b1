"""Mixing sources to target weights with hash-threshold histograms (no sort).

Every document gets a 60-bit hash of its id and text.  A source that must give
``k`` whole copies of itself plus a remainder takes one copy more of exactly
those documents whose hash lies below a threshold.  The threshold is found by
nested histograms: words per (source, top 15 bits), the bucket in which the
remainder runs out, then the next 15 bits of that bucket only, and so on; the
last level separates single hash values.

The document at the boundary rarely fits.  Left out, it leaves words to give to
shorter documents beyond it; taken, it makes others go, from hash 0 on.  Both
ways are followed by further thresholds of the same kind, each among documents
no longer than what is still off, until no such document is left; the nearer
end counts.  Documents are filtered by comparing hashes and sizes, never sorted.

What goes to the driver is a few rows per source: weights are a setting per
source, so the list of sources is as long as that setting.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piisift.llm.common import cut, unused, word_count

#: Bits of a hash and of a histogram level; thresholds tried after the first (each is off by less than the last boundary's document).
HASH_BITS, LEVEL_BITS, CORRECTIONS = 60, 15, 12


def weights_by_rank(sources: Sequence[str | None], cycle: Sequence[int] = (5, 2, 1)) -> dict[str | None, int]:
    """Weights dealt in turn to the sources in code point order, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def share_out(sizes: dict, weights: dict, total: int, most: int = 3) -> dict:
    """Targets by weight, none above ``most`` times its source's size; the excess is shared again by weight until none is above."""
    capped: set = set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        weight = sum(weights[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and Fraction(rest * weights[s], weight) > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else rest * weights[s] / weight for s in sizes}
        capped |= over


def _hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


ADDED = ["size", "source_size", "target", "taken"]


def _mixed(docs: DataFrame, id_col: str, source_col: str, text_col: str, cycle: Sequence[int], most: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with four columns more, under names of their own: size, source's size, target and how often the mix takes a document."""
    spark = docs.sparkSession
    h, size, name, source_size, target, copies, bands, times = unused(docs.columns, "h", "size", "source", "source_size", "target", "copies", "bands", "times")
    base = docs.withColumns({size: word_count(F.col(text_col)), h: _hash(id_col, text_col)})
    rows = cut(base.select(F.col(source_col).alias("s"), F.col(h).alias("h"), F.col(size).alias("size")))  # the histograms read this thin table, not the texts
    sizes = {r["s"]: r["n"] for r in rows.groupBy("s").agg(F.sum("size").alias("n")).collect()}
    targets = share_out(sizes, weights_by_rank(list(sizes), cycle), sum(sizes.values()), most) if sizes else {}
    whole = {s: min(most, int(targets[s] // n)) if n else 0 for s, n in sizes.items()}
    chosen = _remainders(rows, {s: targets[s] - whole[s] * n for s, n in sizes.items() if whole[s] < most and n})
    plan = [(s, n, targets[s], whole[s], chosen.get(s, [])) for s, n in sizes.items()]
    band = "struct<first:long,end:long,longest:long,sign:int>"
    final = spark.createDataFrame(plan, f"{name} string, {source_size} long, {target} double, {copies} int, {bands} array<{band}>")
    mixed = base.join(final, base[source_col].eqNullSafe(final[name]))
    hits = F.filter(bands, lambda b: (F.col(h) >= b["first"]) & (F.col(h) < b["end"]) & (F.col(size) <= b["longest"]))
    mixed = mixed.withColumn(times, F.col(copies) + F.aggregate(hits, F.lit(0), lambda acc, b: acc + b["sign"]))
    return mixed.select(*docs.columns, size, source_size, target, times), [size, source_size, target, times]


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cycle: Sequence[int] = (5, 2, 1),
    most: int = 3,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``taken`` (words the mix takes, copies counted).

    A document is taken whole, 0 to ``most`` times.  Null texts have size 0; a
    null source is a source of its own (last in order), an empty name another.
    Rows that repeat an id with the same text share a hash and are taken alike.
    Columns named like an added one are replaced (but for those named by the
    arguments).  Reruns agree: the choice depends on ids and texts only.  An
    empty table gives an empty result.
    """
    mixed, (size, source_size, target, times) = _mixed(docs, id_col, source_col, text_col, cycle, most)
    keep = [c for c in docs.columns if c not in ADDED or c in (id_col, source_col, text_col)]
    added = [F.col(size), F.col(source_size), F.col(target), F.col(size) * F.col(times)]
    return mixed.select(*keep, *[c.alias(n) for c, n in zip(added, ADDED, strict=True) if n not in keep])


def _remainders(rows: DataFrame, wanted: dict) -> dict:
    """Per source the bands ``(first hash, end hash, longest size, sign)`` whose documents together come near the words wanted.

    A band gives its documents one copy more, or takes it back.  Two ways are
    followed side by side from the first boundary: without its document more
    are added behind, with it some from hash 0 on are taken back.
    """
    top = 1 << HASH_BITS
    ways: dict = {}  # (source, way) -> (bands, words still off, sign, range to search)
    nearest: dict = {}

    def note(s, bands: list, off: float) -> None:
        if s not in nearest or abs(off) < nearest[s][0]:
            nearest[s] = (abs(off), bands)

    first = _thresholds(rows, {(s, 0): (0, top, want, top) for s, want in wanted.items()})
    for (s, _), (edge, below, n) in first.items():
        want = wanted[s]
        without, with_edge = [(0, edge, top, 1)], [(0, edge + 1, top, 1)]
        note(s, without, want - below)
        note(s, with_edge, below + n - want)
        ways[s, 0] = (without, want - below, 1, (edge + 1, top))
        ways[s, 1] = (with_edge, below + n - want, -1, (0, edge))
    for _ in range(CORRECTIONS):
        ways = {k: w for k, w in ways.items() if w[1] >= 1 and w[3][0] < w[3][1]}
        if not ways:
            break
        found = _thresholds(rows, {k: (*span, off, int(off)) for k, (_, off, _, span) in ways.items()})
        onward = {}
        for k, (edge, below, n) in found.items():
            bands, off, sign, (start, stop) = ways[k]
            fits = below + n <= off  # then all documents of the range that are short enough are in
            bands = [*bands, (start, edge + 1 if fits else edge, int(off), sign)]
            off -= below + (n if fits else 0)
            note(k[0], bands, off)
            onward[k] = (bands, off, sign, (edge + 1, stop))
        ways = onward
    return {s: [tuple(map(int, b)) for b in bands] for s, (_, bands) in nearest.items()}


def _thresholds(rows: DataFrame, wanted: dict) -> dict:
    """For each key the hash at which the words wanted run out, the words below it and at it.

    ``wanted``: (source, way) -> (first hash, end hash, words wanted, longest
    document counted).  One histogram per level, of the boundary bucket only;
    one row per key comes back.
    """
    spark, found = rows.sparkSession, {k: (first, 0, 0) for k, (first, _, _, _) in wanted.items()}
    ends = {k: w[1] for k, w in wanted.items()}
    keys = list(wanted)
    by_hash = Window.partitionBy("k").orderBy("bucket")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        # the first level starts at the range's first hash, later ones at the boundary bucket
        grid = [(i, k[0], max(wanted[k][0], found[k][0]), min(ends[k], wanted[k][1]), float(wanted[k][2]), wanted[k][3], found[k][1]) for i, k in enumerate(keys) if k in found]
        if not grid:
            break
        grid = spark.createDataFrame(grid, "k int, t string, lo long, end long, want double, longest long, got long")
        inside = (F.col("h") >= F.col("lo")) & (F.col("h") < F.col("end")) & (F.col("size") <= F.col("longest")) & (F.col("size") > 0)
        hist = (
            rows.join(F.broadcast(grid), rows["s"].eqNullSafe(grid["t"]) & inside)  # two rows a source
            .groupBy("k", "want", "got", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("n"))
        )
        below = hist.withColumn("below", F.col("got") + F.sum("n").over(by_hash) - F.col("n"))
        # the last bucket that starts below the wanted words holds the boundary
        at = below.where(F.col("below") < F.col("want")).groupBy("k").agg(F.max(F.struct("bucket", "below", "n")).alias("m")).collect()
        seen = {keys[r["k"]]: r["m"] for r in at}
        found = {k: (m["bucket"] << shift, m["below"], m["n"]) for k, m in seen.items()}
        ends = {k: (m["bucket"] + 1) << shift for k, m in seen.items()}
    return found


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cycle: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, with the columns and values of ``docs``.

    Documents without words cost nothing and are kept once.
    """
    mixed, (size, _, _, times) = _mixed(docs, id_col, source_col, text_col, cycle, most)
    often = F.when(F.col(size) == 0, F.lit(1)).otherwise(F.col(times))
    (copy,) = unused(mixed.columns, "copy")
    return mixed.where(often > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), often))).select(*docs.columns)
