"""Validators as Column predicates (V1 Luhn, V2 RRN, V3 digit count, strip)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from piisift.functions.arrays import let
from piisift.config import (
    ACCOUNT_MIN_DIGITS,
    LUHN_MAX_DIGITS,
    LUHN_MIN_DIGITS,
    NON_ASCII_DIGIT_VALUES,
    NON_ASCII_DIGITS,
    PY_WHITESPACE,
    RRN_WEIGHTS,
)


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: removes every ``isspace`` code point at both ends."""
    return F.btrim(col, F.lit(PY_WHITESPACE))


def ascii_digits(col: Column) -> Column:
    """Map Unicode decimal digits to ASCII 1:1, so ``cast(int)`` equals ``int(ch)``."""
    return F.translate(col, NON_ASCII_DIGITS, NON_ASCII_DIGIT_VALUES)


def digits_only(col: Column) -> Column:
    """``re.sub(r'\\D', '', v)`` with digits normalised to ASCII."""
    return ascii_digits(F.regexp_replace(col, F.lit(r"(?U)\D"), F.lit("")))


def _digit_at(digits: Column, pos0: Column) -> Column:
    return F.substring(digits, pos0 + 1, 1).cast("int")


def luhn_valid(value: Column) -> Column:
    """Luhn check on the digits of ``value`` (13..19 digits)."""

    def check(rev: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            v = x.cast("int")
            doubled = F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
            term = F.when(acc["i"] % 2 == 1, doubled).otherwise(v)
            return F.struct((acc["i"] + 1).alias("i"), (acc["t"] + term).alias("t"))

        init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("t"))
        total = F.aggregate(rev, init, add, lambda acc: acc["t"])
        n = F.size(rev)
        # CASE evaluates the sum only for plausible lengths.
        return F.when(n.between(LUHN_MIN_DIGITS, LUHN_MAX_DIGITS), total % 10 == 0).otherwise(F.lit(False))

    # Digits right-to-left, computed once.
    return let(F.reverse(F.regexp_extract_all(ascii_digits(value), F.lit("[0-9]"), 0)), check)


def rrn_valid(value: Column) -> Column:
    """Resident-number check: 14 chars with ``-``, month, day, gender digit, checksum."""

    def check(d: Column) -> Column:
        shape_ok = value.contains("-") & (F.length(value) == 14) & (F.length(d) == 13) & d.rlike("^[0-9]{13}$")
        month = F.substring(d, 3, 2).cast("int")
        day = F.substring(d, 5, 2).cast("int")
        gender = _digit_at(d, F.lit(6))
        total = _digit_at(d, F.lit(0)) * RRN_WEIGHTS[0]
        for i, w in enumerate(RRN_WEIGHTS[1:], start=1):
            total = total + _digit_at(d, F.lit(i)) * w
        check_digit = F.pmod(F.lit(11) - F.pmod(total, F.lit(11)), F.lit(10))
        body_ok = month.between(1, 12) & day.between(1, 31) & gender.isin(1, 2, 3, 4) & (check_digit == _digit_at(d, F.lit(12)))
        # Guard the casts: the arithmetic only runs on well-formed values.
        return F.when(shape_ok, body_ok).otherwise(F.lit(False))

    return let(ascii_digits(F.regexp_replace(value, "-", "")), check)


def enough_account_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, F.lit(r"(?U)\D"), F.lit(""))) >= ACCOUNT_MIN_DIGITS
