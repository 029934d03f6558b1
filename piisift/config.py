"""Configuration: the fixed values of the detection rules, weights and messages.

Everything under "FIXED VALUES" must equal the behaviour being reproduced (rule
patterns, confidences, weights, thresholds, messages, caps).  Nothing else in the
package hard-codes a rule; the column builders in ``piisift.functions`` read this
module.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the reproduced behaviour; written in the
# order the rules are applied)
# ---------------------------------------------------------------------------

#: Regex rules, in emission order.  ``(ptype, pattern, confidence, group)``.
#: ``group=1`` means value and span come from capture group 1, else the whole match.
#: Patterns are written in Python ``re`` syntax; ``piisift.functions.dialect``
#: translates ``\s`` and ``\b`` so that java.util.regex matches the same spans.
RULES: list[tuple[str, str, float, int]] = [
    ("PHONE", r"01[016789]-?\d{3,4}-?\d{4}", 0.9, 0),
    ("PHONE", r"0\d{1,2}-\d{3,4}-\d{4}", 0.9, 0),
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0.95, 0),
    ("CARD", r"\b[\d\s-]{13,25}\b", 0.98, 0),
    ("RRN", r"\b\d{6}-[1-4]\d{6}\b", 0.99, 0),
    ("ACCOUNT", r"(?:계좌|계좌번호|account|계좌\s*번호)[\s:]*([0-9-]{10,20})", 0.85, 1),
    ("ACCOUNT", r"\b\d{3}-\d{2,3}-\d{6,8}\b", 0.85, 0),
    ("ADDRESS", r"(?:서울|부산|대구|인천|광주|대전|울산|경기|강원|충북|충남|전북|전남|경북|경남|제주)[시도군구]?\s*[가-힣\s\d-]+(?:동|로|가|길|번지|호)", 0.8, 0),
    ("ADDRESS", r"\b\d{5}\b", 0.8, 0),
    ("ID_NUMBER", r"(?:사번|학번|직번|회원번호|고객번호)[\s:]*[A-Z0-9-]{4,15}", 0.6, 0),
    ("ID_NUMBER", r"\b[A-Z]{2,4}\d{4,8}\b", 0.6, 0),
]

#: Opt-in NAME candidate rules (the reproduced detector computes but never emits
#: them, so they are off by default and never feed the merge).
NAME_RULES: list[tuple[str, str, float, int]] = [
    ("NAME", r"(?:이름은?|성명은?|성함은?|이름이)\s*([김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구원태선설마길연방명기반왕금옥육인맹제갈선우남궁독고황보제][가-힣]{1,2})", 0.7, 1),
    ("NAME", r"([김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구원태선설마길연방명기반왕금옥육인맹제갈선우남궁독고황보제][가-힣]{1,2})(?:님|씨|선생|군|양|학생|고객|손님)", 0.7, 1),
    ("NAME", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", 0.7, 0),
]

#: Risk weight per type; any other type weighs ``DEFAULT_WEIGHT``.
WEIGHTS: dict[str, float] = {
    "RRN": 1.0,
    "CARD": 0.9,
    "ACCOUNT": 0.8,
    "NAME": 0.7,
    "PHONE": 0.6,
    "EMAIL": 0.5,
    "ADDRESS": 0.6,
    "ID_NUMBER": 0.4,
}
DEFAULT_WEIGHT = 0.2

#: score = min(100, round(100 * (1 - exp(-R / SCORE_SCALE)))), 0 when R == 0.
SCORE_SCALE = 3.0
#: A guarded answer is blocked at this score (or on a detected injection).
BLOCK_THRESHOLD = 70

#: Luhn accepts 13..19 digits; RRN checksum weights for the first 12 digits.
LUHN_MIN_DIGITS = 13
LUHN_MAX_DIGITS = 19
RRN_WEIGHTS = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
#: ACCOUNT candidates need at least this many digits.
ACCOUNT_MIN_DIGITS = 10
#: LLM findings need confidence strictly above this.
LLM_MIN_CONFIDENCE = 0.3
LLM_DEFAULT_CONFIDENCE = 0.5

#: Allow-list kinds and the match type each one filters.
ALLOWLIST_KINDS = {"phones": "PHONE", "emails": "EMAIL", "accounts": "ACCOUNT"}
#: Default allow-list (the shipped list file).
DEFAULT_ALLOWLIST: dict[str, list[str]] = {
    "phones": ["1599-1111", "112", "1588-1234", "010-9999-8888"],
    "emails": ["support@company.com", "noreply@domain.com"],
    "accounts": ["000-000-000-000"],
}

#: Answers of a blocked guard.
MSG_INJECTION = "악의적인 프롬프트 인젝션이 탐지되어 응답을 제공할 수 없습니다."
MSG_PII = "죄송합니다. 개인정보가 포함된 내용으로 인해 응답을 제공할 수 없습니다."

#: Verdict used when no model verdict exists for a text.
VERDICT_NO_LLM_DETAILS = "LLM not available"
VERDICT_PARSE_ERROR_DETAILS = "parsing_error"

#: Document assembly: page header, separator, length cap and its notice (the
#: braces in the notice are literal).
PAGE_HEADER = "[페이지 {n}]\n"
PAGE_SEPARATOR = "\n"
DOC_MAX_LENGTH = 10000
DOC_CAP_NOTICE = "\n\n[텍스트가 너무 길어서 {max_length}자까지만 분석합니다.]"
#: Document report: entity cap and preview length.
REPORT_MAX_ENTITIES = 20
REPORT_PREVIEW_CHARS = 400
REPORT_PREVIEW_ELLIPSIS = "..."

# ---------------------------------------------------------------------------
# Character classes derived by rule from Python's own definitions
# ---------------------------------------------------------------------------

#: Every code point Python's ``str.isspace`` accepts (``\s`` and ``strip()``).
PY_WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

#: Decimal digits (category Nd) outside ASCII and their ASCII values, so that
#: digit arithmetic on Unicode digits matches ``int(ch)``.
_ND = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
NON_ASCII_DIGITS = "".join(_ND)
NON_ASCII_DIGIT_VALUES = "".join(str(unicodedata.digit(ch)) for ch in _ND)


@dataclass(frozen=True)
class DetectorConfig:
    """Knobs a user can change; defaults reproduce the reference behaviour."""

    allowlist: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in DEFAULT_ALLOWLIST.items()})
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    default_weight: float = DEFAULT_WEIGHT
    block_threshold: int = BLOCK_THRESHOLD
    #: Opt-in NAME candidates (D8-D10).  Off = parity.
    name_candidates: bool = False
    #: Skip a rule when a cheap necessary condition fails (same results, faster).
    gates: bool = True
    #: Null the raw values in ``matches`` of blocked rows.
    redact_values: bool = False

    def rules(self) -> list[tuple[str, str, float, int]]:
        if not self.name_candidates:
            return list(RULES)
        # NAME is emitted after ACCOUNT and before ADDRESS.
        cut = max(i for i, r in enumerate(RULES) if r[0] == "ACCOUNT") + 1
        return RULES[:cut] + NAME_RULES + RULES[cut:]
