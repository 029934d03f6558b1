"""Detection job (J1): regex candidates -> validators -> allow-list -> merge.

Everything is a projection over the text table: no shuffle, and the same
expressions run unchanged on a streaming DataFrame.  Three projections are
stacked on purpose:

1. ``_safe`` text and the cheap gate booleans,
2. the candidate array (the regex work, each rule evaluated once),
3. the merged ``matches``.

Catalyst does not collapse a projection whose non-trivial outputs are read
more than once, so each regex runs once per row (checked with ``explain``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.config import ALLOWLIST_KINDS, RULES, DetectorConfig
from piisift.functions.matches import (
    empty_matches,
    make_match,
    merge_matches,
    public_matches,
)
from piisift.functions.spans import has_marker, has_match, match_spans, safe_text
from piisift.functions.validators import enough_account_digits, luhn_valid, py_strip, rrn_valid
from piisift.operators.allowlist import membership

DEFAULT_CONFIG = DetectorConfig()

#: Cheap necessary conditions per (type, n-th rule of that type).  A rule is
#: skipped for a row unless all of its gates hold; every gate is implied by a
#: validated match of the rule, so results do not change.
RULE_GATES: dict[tuple[str, int], tuple[str, ...]] = {
    ("PHONE", 0): ("digit",),
    ("PHONE", 1): ("digit", "dash"),
    ("EMAIL", 0): ("at",),
    ("CARD", 0): ("digit",),  # Luhn needs >= 13 digits
    ("RRN", 0): ("digit", "dash"),
    ("ACCOUNT", 0): ("digit",),  # >= 10 digits
    ("ACCOUNT", 1): ("digit", "dash"),
    ("ADDRESS", 0): ("hangul",),
    ("ADDRESS", 1): ("digit",),
    ("ID_NUMBER", 0): ("hangul",),
    ("ID_NUMBER", 1): ("digit",),
    ("NAME", 0): ("hangul",),
    ("NAME", 1): ("hangul",),
}

#: For validated rules, a pattern every *valid* match must contain; used as the
#: find-only gate instead of the rule pattern when it is cheaper to scan.  A
#: Luhn-valid CARD holds 13+ digits separated only by whitespace or hyphens.
VALID_HINTS: dict[tuple[str, int], str] = {
    ("CARD", 0): r"\d(?:[\s-]*\d){12}",
}

#: Patterns that every match must contain, tried before the rule's own where they are cheaper to scan.
RULE_HINTS: dict[tuple[str, int], str] = {
    # a city's name: other letters fail on one range test
    ("ADDRESS", 0): "(?=[가-힣])" + RULES[[r[0] for r in RULES].index("ADDRESS")][1].partition(")")[0] + ")",
}

GATE_COLUMNS = {
    "digit": lambda safe: safe.rlike(r"(?U)\d"),
    "hangul": lambda safe: safe.rlike("[가-힣]"),
    "at": lambda safe: F.instr(safe, "@") > 0,
    "dash": lambda safe: F.instr(safe, "-") > 0,
}


def _indexed_rules(config: DetectorConfig, types: set[str] | None):
    seen: dict[str, int] = {}
    for ordinal, (ptype, pattern, conf, group) in enumerate(config.rules()):
        k = seen.get(ptype, 0)
        seen[ptype] = k + 1
        if types is None or ptype in types:
            yield ordinal, k, ptype, pattern, conf, group


def _allowed(ptype: str, value: Column, config: DetectorConfig) -> Column | None:
    """Row-form allow-list test (exact string equality), or None if the type has none."""
    for kind, kt in ALLOWLIST_KINDS.items():
        if kt == ptype:
            values = list(dict.fromkeys(config.allowlist.get(kind, []) or []))
            if not values:
                return None
            # ``isin`` on literals becomes a hash-set lookup (InSet) for long lists.
            return value.isin(values)
    return None


def _sql_str(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def allowlist_sql(var: str, lists: dict[str, list[str]]) -> str | None:
    """SQL predicate "``var`` is allow-listed" (exact equality per kind), or None.

    Written as SQL text so a long list is one expression handed to the JVM in a
    single call; Catalyst turns each literal ``IN`` list into a hash set (InSet).
    """
    terms = []
    for kind, ptype in ALLOWLIST_KINDS.items():
        values = list(dict.fromkeys(v for v in (lists.get(kind) or []) if v is not None))
        if values:
            terms.append(f"({var}.ptype = {_sql_str(ptype)} AND {var}.value IN ({', '.join(_sql_str(v) for v in values)}))")
    return " OR ".join(terms) if terms else None


def drop_allowlisted(array_col: str, lists: dict[str, list[str]]) -> Column:
    """V4 on an array column of matches: keep those not on the allow-list."""
    pred = allowlist_sql("m", lists)
    if pred is None:
        return F.col(array_col)
    return F.expr(f"filter({array_col}, m -> NOT ({pred}))")


def count_allowlisted(array_col: str, lists: dict[str, list[str]]) -> Column:
    pred = allowlist_sql("m", lists)
    if pred is None:
        return F.lit(0)
    return F.expr(f"size(filter({array_col}, m -> {pred}))")


#: V1-V3: the validator a type's candidates must pass (by value).
VALIDATORS = {"CARD": luhn_valid, "RRN": rrn_valid, "ACCOUNT": enough_account_digits}


def rule_matches(
    text: Column,
    safe: Column,
    ordinal: int,
    ptype: str,
    pattern: str,
    conf: float,
    group: int,
    validate: bool = True,
) -> Column:
    """Validated matches of one rule as an array of match structs (the
    allow-list is applied to all rules at once by :func:`with_candidates`)."""
    spans = match_spans(safe, pattern, group)

    def to_match(sp: Column) -> Column:
        # The segment already holds the match; slicing the text (a walk from its
        # start) is only needed when marker characters were translated away.
        raw = F.when(F.col("_g_marker"), F.substring(text, sp["s"] + 1, sp["e"] - sp["s"])).otherwise(sp["v"])
        value = py_strip(raw) if ptype == "CARD" else raw  # CARD: stripped value, unstripped span
        return make_match(sp["s"], sp["e"], ordinal, ptype, value, conf, "regex")

    out = F.transform(spans, to_match)
    validator = VALIDATORS.get(ptype) if validate else None
    if validator is not None:
        out = F.filter(out, lambda m: validator(m["value"]))
    return out


def with_gates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Projection 1: marker flag, marker-safe text and the cheap gate booleans."""
    df = df.withColumn("_g_marker", has_marker(F.col(text_col)))
    df = df.withColumn("_safe", safe_text(F.col(text_col), F.col("_g_marker")))
    return df.withColumns({f"_g_{name}": fn(F.col("_safe")) for name, fn in GATE_COLUMNS.items()})


#: Unresolved columns of the running application (a new application clears them).
_COLUMN_CACHE: dict[tuple, Column] = {}
_CACHE_OWNER: list[str] = []


def cached_column(key: tuple, build: Callable[[], Column]) -> Column:
    """The column that ``build`` gives, built once per application.

    Building one of the large expressions takes hundreds of calls to the JVM;
    they refer to columns by name only, so one instance serves every DataFrame.
    """
    from pyspark import SparkContext

    active = SparkContext._active_spark_context
    owner = active.applicationId if active is not None else ""
    if _CACHE_OWNER != [owner]:
        _COLUMN_CACHE.clear()
        _CACHE_OWNER[:] = [owner]
    if key not in _COLUMN_CACHE:
        _COLUMN_CACHE[key] = build()
    return _COLUMN_CACHE[key]


def candidates_column(
    text_col: str = "text",
    config: DetectorConfig = DEFAULT_CONFIG,
    types: set[str] | None = None,
    validate: bool = True,
    gates: bool | None = None,
) -> Column:
    """Projection 2: all rule matches, in emission order (needs :func:`with_gates`).

    The expression is unresolved (columns by name), so one instance serves every
    DataFrame; it is built once per configuration and session.
    """
    # The expression depends on the rules, validation and gating only (the
    # allow-list is applied afterwards, in :func:`with_candidates`).
    use_gates = config.gates if gates is None else gates
    key = ("candidates", text_col, tuple(config.rules()), tuple(sorted(types or [])), types is None, validate, use_gates)
    return cached_column(key, lambda: _build_candidates_column(text_col, config, types, validate, use_gates))


def _build_candidates_column(text_col: str, config: DetectorConfig, types: set[str] | None, validate: bool, use_gates: bool) -> Column:
    text, safe = F.col(text_col), F.col("_safe")
    parts = []
    for ordinal, k, ptype, pattern, conf, group in _indexed_rules(config, types):
        arr = rule_matches(text, safe, ordinal, ptype, pattern, conf, group, validate)
        if use_gates:
            hint = VALID_HINTS.get((ptype, k)) if validate else None
            cond = has_match(safe, hint or pattern)
            if (ptype, k) in RULE_HINTS:
                cond = has_match(safe, RULE_HINTS[ptype, k]) & cond
            for g in RULE_GATES.get((ptype, k), ()):
                cond = F.col(f"_g_{g}") & cond
            arr = F.when(cond, arr).otherwise(empty_matches())
        parts.append(arr)
    if not parts:
        return empty_matches()
    cands = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.when(text.isNull(), empty_matches()).otherwise(cands)


def with_candidates(
    df: DataFrame,
    text_col: str = "text",
    config: DetectorConfig = DEFAULT_CONFIG,
    types: set[str] | None = None,
    validate: bool = True,
    allowlist: bool = True,
    gates: bool | None = None,
    out_col: str = "_cands",
) -> DataFrame:
    """Add the pre-merge candidate array (internal match structs)."""
    gated = with_gates(df, text_col)
    col = candidates_column(text_col, config, types, validate, gates)
    out = gated.withColumn(out_col, col).drop("_safe", "_g_marker", *[f"_g_{g}" for g in GATE_COLUMNS])
    if allowlist and allowlist_sql("m", config.allowlist) is not None:
        out = out.withColumn(out_col, drop_allowlisted(out_col, config.allowlist))
    return out


def detect(
    df: DataFrame,
    text_col: str = "text",
    config: DetectorConfig = DEFAULT_CONFIG,
    extra_matches_col: str | None = None,
    internal: bool = False,
    allowlist_table: DataFrame | None = None,
) -> DataFrame:
    """Add ``matches`` (merged, disjoint, sorted by start).

    ``extra_matches_col`` holds model findings (internal match structs, already
    normalised); they are appended after the regex matches and merged with them
    (the allow-list does not apply to them).  ``allowlist_table`` ``(kind,
    value)``, of any size, applies on top of ``config.allowlist`` (see
    :func:`with_listed_dropped`).  With ``internal=True`` the matches keep their
    ordinal field.
    """
    out = with_candidates(df, text_col, config)
    if allowlist_table is not None:
        out = with_listed_dropped(out, listed_keys(df, text_col, config), allowlist_table)

    def merged() -> Column:
        cands = F.col("_cands")
        if extra_matches_col:
            cands = F.concat(cands, F.coalesce(F.col(extra_matches_col), empty_matches()))
        return merge_matches(cands)

    out = out.withColumn("matches", cached_column(("merged", extra_matches_col), merged)).drop("_cands")
    if not internal:
        out = out.withColumn("matches", cached_column(("public",), lambda: public_matches(F.col("matches"))))
    return out


LISTED_TYPES = set(ALLOWLIST_KINDS.values())


def listed_keys(df: DataFrame, text_col: str, config: DetectorConfig) -> DataFrame:
    """``(ptype, value)`` of every candidate that an allow-list can drop (only these rules run)."""
    if df.isStreaming:
        raise ValueError("an allow-list table needs the whole input: apply it to static rows, or give DetectorConfig.allowlist")
    only = with_candidates(df.select(text_col), text_col, config, types=LISTED_TYPES)
    return explode_matches(only, [], "_cands").select("ptype", "value")


def with_listed_dropped(cands: DataFrame, keys: DataFrame, allow: DataFrame, array_col: str = "_cands") -> DataFrame:
    """V4 with a table: candidates that it lists leave the array; no text is exchanged.

    The list's filters are part of the row expression; ``keys`` are the
    candidates they must be exact for (see :mod:`piisift.operators.allowlist`).
    """
    listed = membership(keys, allow)
    types = sorted(LISTED_TYPES)
    kept = listed(lambda test: F.filter(array_col, lambda m: ~(m["ptype"].isin(*types) & test(m["ptype"], m["value"]))))
    return cands.withColumn(array_col, kept)


def explode_matches(df: DataFrame, keys: list[str], matches_col: str = "matches") -> DataFrame:
    """Long form: one row per match with scalar columns (and its position ``pos``).

    ``posexplode_outer`` + a filter on the generated ``pos``: a plain explode
    makes Catalyst infer ``size(matches) > 0`` and push it below the projection
    that computes ``matches``, which would run every regex twice.  A predicate on
    the generator's output cannot move below the generator.
    """
    exploded = df.select(*keys, F.posexplode_outer(matches_col).alias("pos", "m"))
    return exploded.where(F.col("pos").isNotNull()).select(*keys, "pos", "m.*")
