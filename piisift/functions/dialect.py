"""Python ``re`` -> java.util.regex, for the handful of constructs the rules use.

The rules are written in Python syntax (that is the behaviour to match).  Spark
evaluates them with java.util.regex, which differs in three places that matter:

* ``\\s``: Python accepts every ``str.isspace`` code point (including U+001C..U+001F);
  Java's Unicode ``\\s`` does not.  We substitute an explicit class.
* ``\\b``: Python's word characters are letters, numbers and ``_``.  Java's
  Unicode ``\\b`` also counts combining marks and joiners.  We substitute an
  explicit look-around boundary over ``[\\p{L}\\p{N}_]``.
* ``\\d``: Unicode decimal digits in Python; ``(?U)`` makes Java agree.
"""

from __future__ import annotations

import re
from functools import lru_cache

from piisift.config import PY_WHITESPACE

WORD_CLASS = r"[\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={WORD_CLASS})(?!{WORD_CLASS})|(?<!{WORD_CLASS})(?={WORD_CLASS}))"


#: A pattern that starts with a class repeated at least once and then a plain character.
LEADING_RUN = re.compile(r"(\[(?:\\.|[^\]\\])+\])\+([^\\\[\](){}.*+?|^$])")


def _class_body(chars: str) -> str:
    """The characters as the inside of a class.  Java tests those below 256 by one bitmap and every
    other item of a class in turn, so what is above is written as ranges."""
    points = sorted(ord(c) for c in chars)
    out = [f"\\x{{{p:X}}}" for p in points if p < 256]
    high = [p for p in points if p >= 256]
    while high:
        n = 1
        while n < len(high) and high[n] == high[0] + n:
            n += 1
        out.append(f"\\x{{{high[0]:X}}}" + (f"-\\x{{{high[n - 1]:X}}}" if n > 1 else ""))
        high = high[n:]
    return "".join(out)


WS_BODY = _class_body(PY_WHITESPACE)

#: Heads, an optional character, white space, a body run, tails: ``(?:a|b)[c]?\\s*[body]+(?:x|y)``.
HEAD_BODY_TAIL = re.compile(r"\(\?:([^()]+)\)(\[[^\]]+\])\?\\s\*(\[[^\]]+\])\+\(\?:([^()]+)\)")


def _next_atom(pattern: str, i: int) -> str | None:
    """The class ``[...]`` or escape at ``pattern[i:]`` if it must match one
    character there (not followed by a quantifier that allows zero)."""
    if i >= len(pattern):
        return None
    if pattern[i] == "\\" and i + 1 < len(pattern):
        end = i + 2
    elif pattern[i] == "[":
        j = i + 1
        while j < len(pattern) and pattern[j] != "]":
            j += 2 if pattern[j] == "\\" else 1
        end = j + 1
    else:
        return None
    rest = pattern[end:]
    if rest[:1] in ("*", "?") or rest.startswith("{0"):
        return None
    return pattern[i:end]


@lru_cache(maxsize=None)
def to_java(pattern: str) -> str:
    """Translate one rule pattern; escapes other than ``\\s``/``\\b`` pass through.

    A ``\\b`` followed by an atom that must match next is preceded by a
    look-ahead on that atom: the same language, but most start positions fail
    on one cheap character test before the two-sided boundary is evaluated.
    """
    out: list[str] = []
    in_class = False
    i = 0
    run = LEADING_RUN.match(pattern)
    if run and re.fullmatch(run[1], run[2]) is None:
        # The run ends where its class ends, so it can only be followed by the literal when taken
        # whole: start it at its first character or where the last match ended, and never give
        # back.  Otherwise each position of a long run would scan the rest of it.
        out.append(rf"(?:\G|(?<!{_translate_atom(run[1])})){_translate_atom(run[1])}++")
        i = len(run[1]) + 1
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            esc = pattern[i + 1]
            if esc == "s":
                out.append(WS_BODY if in_class else f"[{WS_BODY}]")
            elif esc == "b" and not in_class:
                atom = _next_atom(pattern, i + 2)
                if atom is not None:
                    out.append(f"(?={_translate_atom(atom)})")
                out.append(BOUNDARY)
            else:
                out.append(ch + esc)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "(?U)" + "".join(out)


@lru_cache(maxsize=None)
def run_form(pattern: str) -> tuple[str, str] | None:
    """A linear-time Java form of a rule with heads, a body run and tails: (what precedes the match, the match), both under ``(?U)``.

    If everything such a rule takes is of the body's class, a match lies in one
    maximal run of that class.  It begins at the run's first head and ends at
    the run's last tail (with a character between), and what follows holds no
    tail; so a run has at most one match and each run needs one attempt, from
    its start.  The rule as written would scan the run again from every head.
    None for any other rule.
    """
    parts = HEAD_BODY_TAIL.fullmatch(pattern)
    if not parts:
        return None
    heads, option, body, tails = parts.groups()
    taken = [*heads.replace("|", ""), *option[1:-1], *tails.replace("|", ""), *PY_WHITESPACE]
    if not all(re.fullmatch(body, c) for c in taken):
        return None
    one = _translate_atom(body)
    return f"(?<!{one})(?:(?!{heads}){one})*+", f"(?:{heads}){one}+(?:{tails})"


def _translate_atom(atom: str) -> str:
    return to_java(atom).removeprefix("(?U)")


def split_group(pattern: str) -> tuple[str, str, str]:
    """Split a pattern with exactly one capturing group into (before, group, after)."""
    depth = 0
    start = None
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            if start is None and not pattern.startswith("(?", i):
                start, depth = i, 0
            if start is not None:
                depth += 1
        elif ch == ")" and start is not None:
            depth -= 1
            if depth == 0:
                return pattern[:start], pattern[start + 1 : i], pattern[i + 1 :]
        i += 1
    raise ValueError(f"no capturing group in {pattern!r}")
