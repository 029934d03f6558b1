"""Match arrays: merge (M1-M3), risk score (R1-R3) and masking (X1) as Columns.

A match is ``struct<span_start, span_end, ord, ptype, value, confidence, source>``.
``ord`` is the emission ordinal (rule position; model findings come after every
rule), so the natural struct order is "by (start, end), ties by emission order".
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piisift.config import DEFAULT_WEIGHT, SCORE_SCALE, WEIGHTS
from piisift.functions.arrays import let

MATCH_FIELDS = [
    T.StructField("span_start", T.IntegerType()),
    T.StructField("span_end", T.IntegerType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("ptype", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()),
]
MATCH_TYPE = T.StructType(MATCH_FIELDS)
MATCHES_TYPE = T.ArrayType(MATCH_TYPE)

#: Public match (no ordinal), the row-form output schema.
PUBLIC_MATCH_TYPE = T.StructType([f for f in MATCH_FIELDS if f.name != "ord"])


def empty_matches() -> Column:
    return F.array().cast(MATCHES_TYPE)


def make_match(start: Column, end: Column, ord_: int | Column, ptype, value: Column, confidence, source) -> Column:
    return F.struct(
        start.cast("int").alias("span_start"),
        end.cast("int").alias("span_end"),
        (ord_ if isinstance(ord_, Column) else F.lit(ord_)).cast("int").alias("ord"),
        (ptype if isinstance(ptype, Column) else F.lit(ptype)).alias("ptype"),
        value.alias("value"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"),
        (source if isinstance(source, Column) else F.lit(source)).alias("source"),
    )


#: Up to this many candidates a text is merged by one fold; beyond it by islands.
SMALL_K = 32


def _fold(sorted_matches: Column) -> Column:
    def step(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        n = F.size(acc)
        return (
            F.when((n == 0) | (m["span_start"] >= last["span_end"]), F.concat(acc, F.array(m)))
            .when(m["confidence"] > last["confidence"], F.concat(F.slice(acc, 1, n - 1), F.array(m)))
            .otherwise(acc)
        )

    return F.aggregate(sorted_matches, empty_matches(), step)


#: Block size of the blocked merge.
MERGE_BLOCK = 64


def _next_last(last: Column, m: Column) -> Column:
    """The fold's state is the last accepted match: ``m`` becomes it when it
    starts at or after its end (append) or is strictly more confident (replace)."""
    return F.when(
        last.isNull() | (m["span_start"] >= last["span_end"]) | (m["confidence"] > last["confidence"]), m
    ).otherwise(last)


def _merge_blocked(s: Column) -> Column:
    """The same fold, in blocks: a scalar-state pass gives each block's incoming
    last-accepted match, then every block independently emits the matches it
    finalises (a match is final once a later one is appended after it).
    ``O(k * block + (k / block)^2)`` for ``k`` candidates, whatever the overlaps."""
    b = MERGE_BLOCK
    n = F.size(s)
    n_blocks = ((n + b - 1) / b).cast("int")
    no_match = F.lit(None).cast(MATCH_TYPE)

    def block(j: Column) -> Column:
        return F.slice(s, j * b + 1, b)

    # Incoming state of each block (exclusive scan with a scalar state).
    def pass_block(acc: Column, j: Column) -> Column:
        out = F.aggregate(block(j), acc["last"], _next_last)
        return F.struct(out.alias("last"), F.concat(acc["ins"], F.array(acc["last"])).alias("ins"))

    init = F.struct(no_match.alias("last"), F.array().cast(MATCHES_TYPE).alias("ins"))
    states = F.aggregate(F.sequence(F.lit(0), n_blocks - 1), init, pass_block)

    def finalise(st: Column) -> Column:
        def emit(j: Column) -> Column:
            def step(acc: Column, m: Column) -> Column:
                last = acc["last"]
                appended = last.isNotNull() & (m["span_start"] >= last["span_end"])
                fin = F.when(appended, F.concat(acc["fin"], F.array(last))).otherwise(acc["fin"])
                return F.struct(fin.alias("fin"), _next_last(last, m).alias("last"))

            start = F.struct(F.array().cast(MATCHES_TYPE).alias("fin"), F.element_at(st["ins"], j + 1).alias("last"))
            return F.aggregate(block(j), start, step, lambda acc: acc["fin"])

        done = F.flatten(F.transform(F.sequence(F.lit(0), n_blocks - 1), emit))
        return F.concat(done, F.array(st["last"]))

    return let(states, finalise)


def merge_matches(cands: Column) -> Column:
    """Resolve overlaps exactly like the reference's ordered merge.

    Sorted by (start, end, ord), the accepted list stays disjoint, so a new match
    can only overlap the *last* accepted one: append when it starts at or after
    that one's end; replace it when strictly more confident; drop otherwise.
    Same-span duplicates fall in the second/third case.  Long arrays use the
    blocked form of the same fold (no quadratic copying of the whole array).
    """

    def on_sorted(s: Column) -> Column:
        return F.when(F.size(s) <= SMALL_K, _fold(s)).otherwise(_merge_blocked(s))

    # Zero or one candidate (most texts): nothing to sort or resolve.
    return F.when(F.size(cands) <= 1, cands).otherwise(let(F.array_sort(cands), on_sorted))


def weight_of(ptype: Column, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT) -> Column:
    w = weights or WEIGHTS
    wmap = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in w.items()))
    return F.coalesce(F.try_element_at(wmap, ptype), F.lit(float(default)))


def risk_value(matches: Column, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT) -> Column:
    """R = sum of type weights over the merged matches."""
    return F.aggregate(matches, F.lit(0.0), lambda acc, m: acc + weight_of(m["ptype"], weights, default))


def score_from_risk(risk: Column) -> Column:
    """0 when R = 0, else min(100, round_half_even(100 * (1 - exp(-R / 3))))."""
    raw = F.least(F.lit(100.0), F.bround(F.lit(100.0) * (F.lit(1.0) - F.exp(-risk / F.lit(SCORE_SCALE))), 0))
    return F.when(risk == 0, F.lit(0)).otherwise(raw.cast("int"))


#: Texts longer than this are sliced through fixed-size chunks when masking.
MASK_CHUNK = 4096


def _chunked_slice(chunks: Column, start: Column, length: Column) -> Column:
    """``text[start : start + length]`` (0-based) from the text's chunks of
    ``MASK_CHUNK`` code points: each piece walks at most its own chunks instead
    of the text from its beginning."""
    c = MASK_CHUNK
    first = (start / c).cast("int")
    last = ((start + length - 1) / c).cast("int")

    def part(j: Column) -> Column:
        lo = F.greatest(start, j * c)
        hi = F.least(start + length, (j + 1) * c)
        return F.substring(F.element_at(chunks, j + 1), lo - j * c + 1, hi - lo)

    return F.when(length <= 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, last), part), ""))


def type_token(m: Column) -> Column:
    return F.concat(F.lit("<"), m["ptype"], F.lit(">"))


def mask_text(text: Column, matches: Column, token: Callable[[Column], Column] = type_token) -> Column:
    """Replace every merged span by ``<TYPE>`` (or what ``token`` makes of the match).

    The merged spans are disjoint and sorted, so one left-to-right pass equals
    the right-to-left slicing of the reference.  Each piece is the gap since the
    previous span's end plus the token; ``zip_with`` pairs a span with the end
    of its predecessor, so the lambdas never re-read the array column.  A plain
    ``substring`` walks the text from its start, so long texts are cut into
    chunks once (``regexp_extract_all``) and each gap is sliced from its chunks:
    linear in the text plus a chunk per span, not text length times spans.
    """
    ends = F.transform(matches, lambda m: m["span_end"])
    prev_ends = F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(matches))
    tail_from = F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + 1

    def pieces(slice_gap) -> Column:
        return F.array_join(
            F.zip_with(
                matches,
                prev_ends,
                lambda m, pe: F.concat(slice_gap(pe, m["span_start"] - pe), token(m)),
            ),
            "",
        )

    direct = pieces(lambda a, n: F.substring(text, a + 1, n))

    def chunked(chunks: Column) -> Column:
        return pieces(lambda a, n: _chunked_slice(chunks, a, n))

    long_text = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{MASK_CHUNK}}}"), 0), chunked)
    body = F.when((F.length(text) <= MASK_CHUNK) | (F.size(matches) <= 1), direct).otherwise(long_text)
    return F.concat(body, F.substr(text, tail_from))


def public_matches(matches: Column) -> Column:
    """Drop the internal ordinal: ``array<struct<ptype,value,span_start,span_end,confidence,source>>``."""
    return F.transform(
        matches,
        lambda m: F.struct(
            m["ptype"].alias("ptype"),
            m["value"].alias("value"),
            m["span_start"].alias("span_start"),
            m["span_end"].alias("span_end"),
            m["confidence"].alias("confidence"),
            m["source"].alias("source"),
        ),
    )
