"""Luhn and resident-number checks against straightforward Python versions."""

import random

from pyspark.sql import functions as F

from piisift.functions.validators import enough_account_digits, luhn_valid, py_strip, rrn_valid


def luhn_py(s):
    d = [int(c) for c in s if c.isdecimal()]
    if not 13 <= len(d) <= 19:
        return False
    total = 0
    for i, x in enumerate(reversed(d)):
        if i % 2:
            x = x * 2 - 9 if x * 2 > 9 else x * 2
        total += x
    return total % 10 == 0


def rrn_py(s):
    if "-" not in s or len(s) != 14:
        return False
    d = s.replace("-", "")
    if len(d) != 13 or not d.isdecimal():
        return False
    w = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
    ok = 1 <= int(d[2:4]) <= 12 and 1 <= int(d[4:6]) <= 31 and int(d[6]) in (1, 2, 3, 4)
    return ok and (11 - sum(int(d[i]) * w[i] for i in range(12)) % 11) % 10 == int(d[12])


def test_luhn_and_rrn_random(spark):
    rnd = random.Random(7)
    vals = ["4111 1111 1111 1111", "4532148803436467", "4532-1488-0343-6467", "", "12", "٤١١١١١١١١١١١١١١١"]
    for _ in range(400):
        n = rnd.randint(10, 21)
        vals.append("".join(rnd.choice("0123456789 -") for _ in range(n)))
        vals.append(f"{rnd.randint(0, 999999):06d}-{rnd.randint(0, 9999999):07d}")
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = df.select("v", luhn_valid(F.col("v")).alias("l"), rrn_valid(F.col("v")).alias("r")).collect()
    for row in got:
        assert row.l == luhn_py(row.v), row.v
        assert row.r == rrn_py(row.v), row.v
    assert any(r.l for r in got) and any(r.r for r in got)


def test_strip_and_account_digits(spark):
    df = spark.createDataFrame([("　 4111 \x1c",), ("123-45-6789",), ("123-45-67890",)], "v string")
    got = df.select(py_strip(F.col("v")).alias("s"), enough_account_digits(F.col("v")).alias("a")).collect()
    assert got[0].s == "4111"
    assert [r.a for r in got] == [False, False, True]
