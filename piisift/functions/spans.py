"""All-match offsets of a regex as a Spark Column ("mark, split, fold").

Spark has ``regexp_extract_all`` but no function returning *where* each match
is.  We obtain Python ``re.finditer`` offsets with built-in expressions only:

1. ``regexp_replace`` wraps every match in two private-use marker characters
   (``MARK_OPEN`` + match + ``MARK_CLOSE``).  Markers already present in the
   text are first translated 1:1 to U+FFFD (``safe_text``), so offsets are
   unchanged and no marker can be forged.
2. ``split`` on ``MARK_CLOSE``: each segment but the last is
   ``<gap before the match> MARK_OPEN <match>``.
3. Match ``i`` ends at the running sum of ``length(segment) - 1`` and starts
   ``len(match)`` earlier: ``struct<s int, e int>``, 0-based, end-exclusive,
   in code points (the unit of Spark ``length`` and ``substring``).  Up to
   ``SMALL_K`` matches an ``aggregate`` carries the sum; beyond that a blocked
   prefix scan does, so a text's cost stays near-linear in its match count.

Everything stays inside the JVM; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piisift.functions.arrays import inclusive_scan, let
from piisift.functions.dialect import run_form, split_group, to_java

MARK_OPEN = "\ue000"
MARK_CLOSE = "\ue001"
MARK_SUBSTITUTE = "\ufffd"

#: ``s``/``e``: offsets; ``v``: the matched text as read from the segment (equal
#: to the original text's slice whenever the text holds no marker character).
SPAN_TYPE = T.ArrayType(
    T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("v", T.StringType())])
)


def has_marker(text: Column) -> Column:
    """Whether the text holds a marker character (byte search)."""
    return (F.instr(text, MARK_OPEN) > 0) | (F.instr(text, MARK_CLOSE) > 0)


def safe_text(text: Column, marker: Column | None = None) -> Column:
    """The text with marker characters neutralised (same length, same matches).

    ``translate`` copies the text with a per-character lookup; the byte search
    of :func:`has_marker` first skips that for the (usual) texts holding none.
    """
    flag = has_marker(text) if marker is None else marker
    return F.when(flag, F.translate(text, MARK_OPEN + MARK_CLOSE, MARK_SUBSTITUTE + MARK_SUBSTITUTE)).otherwise(text)


def _marked(safe: Column, pattern: str, group: int) -> Column:
    run = None if group else run_form(pattern)
    if run:
        java, replacement = f"(?U)({run[0]})({run[1]})", "$1" + MARK_OPEN + "$2" + MARK_CLOSE
    elif group:
        before, grp, after = split_group(pattern)
        java = to_java(f"({before})({grp})({after})")
        replacement = "$1" + MARK_OPEN + "$2" + MARK_CLOSE + "$3"
    else:
        java = to_java(pattern)
        replacement = MARK_OPEN + "$0" + MARK_CLOSE
    return F.regexp_replace(safe, F.lit(java), F.lit(replacement))


#: Up to this many matches a text uses the direct fold; beyond it the scan.
SMALL_K = 32


def _fold_spans(segs: Column) -> Column:
    """Running-offset fold over all segments (the trailing one has no marker and
    is skipped); appends copy the array, so only for short arrays."""
    init = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN_TYPE).alias("out"))

    def step(acc: Column, seg: Column) -> Column:
        gap = F.length(F.substring_index(seg, MARK_OPEN, 1))
        start = acc["pos"] + gap
        end = start + F.length(seg) - gap - 1
        span = F.struct(start.alias("s"), end.alias("e"), F.substring_index(seg, MARK_OPEN, -1).alias("v"))
        appended = F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.when(F.instr(seg, MARK_OPEN) > 0, appended).otherwise(acc)

    return F.aggregate(segs, init, step, lambda acc: acc["out"])


def _scan_spans(body: Column) -> Column:
    """Same spans via a prefix sum of segment lengths: O(k log k) for k matches."""

    def with_ends(ends: Column) -> Column:
        def span(seg: Column, end: Column) -> Column:
            match_len = F.length(seg) - F.length(F.substring_index(seg, MARK_OPEN, 1)) - 1
            return F.struct((end - match_len).alias("s"), end.alias("e"), F.substring_index(seg, MARK_OPEN, -1).alias("v"))

        return F.zip_with(body, ends, span)

    lens = F.transform(body, lambda seg: F.length(seg) - 1)
    return let(inclusive_scan(lens, lambda a, b: a + b, F.lit(0)), with_ends)


def match_spans(safe: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<s,e>>`` of the non-overlapping matches of ``pattern``.

    ``safe`` must come from :func:`safe_text`.  With ``group=1`` the spans are
    those of capture group 1 while matching proceeds over whole matches, as
    ``finditer`` + ``match.span(1)`` does.  Segment ``i`` holds the gap before
    match ``i``, one marker and the match, so match ``i`` ends at the running
    sum of ``length(segment) - 1``.
    """
    segs = F.split(_marked(safe, pattern, group), MARK_CLOSE)

    def on_segments(seg_arr: Column) -> Column:
        body = F.slice(seg_arr, 1, F.size(seg_arr) - 1)
        return F.when(F.size(seg_arr) <= SMALL_K + 1, _fold_spans(seg_arr)).otherwise(let(body, _scan_spans))

    return let(segs, on_segments)


def has_match(safe: Column, pattern: str) -> Column:
    """Cheap find-only test with the same dialect (no copy of the text)."""
    run = run_form(pattern)
    return safe.rlike(f"(?U){run[0]}{run[1]}" if run else to_java(pattern))
