"""Character classes as Java tests them, and what every match of a rule holds."""

import re

from piisift.config import PY_WHITESPACE, RULES
from piisift.functions.dialect import WS_BODY
from piisift.operators.detect import RULE_HINTS


def test_white_space_is_few_items():
    def point(item):
        return int(item.strip("\\x{}"), 16)

    held, high = set(), 0
    for item in re.findall(r"\\x\{[0-9A-F]+\}(?:-\\x\{[0-9A-F]+\})?", WS_BODY):
        first, _, last = item.partition("-")
        held.update(chr(c) for c in range(point(first), point(last or first) + 1))
        high += point(first) >= 256
    assert held == set(PY_WHITESPACE) and high <= 6


def test_hints_hold_in_every_match():
    rules: dict[str, list[str]] = {}
    for ptype, pattern, _, _ in RULES:
        rules.setdefault(ptype, []).append(pattern)
    for (ptype, k), hint in RULE_HINTS.items():
        for text in ("제주 가동", "서울시 역삼동", "경남 1-2 길 a 부산 12번지"):
            for m in re.finditer(rules[ptype][k], text):
                assert re.search(hint, m.group())
