"""DuckDB oracle SQL for every registered query.

An independent formulation of the same semantics in plain SQL, used only to
check the Spark jobs.  Spans: the marker + split trick with a window running
sum (instead of a fold); merge: ``list_reduce``; mask: ``string_agg`` over gaps.

RE2 (DuckDB) differs from Python ``re``: ``\\b``, ``\\d`` and ``\\s`` are ASCII.
The oracle matches on a shadow text of the same length: Python whitespace that
RE2's ``\\s`` lacks becomes a space, and for ``\\b`` rules every non-ASCII letter
or number becomes ``_`` (a word character no rule class contains).  Values are
sliced from the original text.  This assumes no non-ASCII decimal digits in the
input (true for the driver tables; checked when this was written).
"""

from __future__ import annotations

from piisift.config import (
    ALLOWLIST_KINDS,
    BLOCK_THRESHOLD,
    DEFAULT_ALLOWLIST,
    DEFAULT_WEIGHT,
    DOC_CAP_NOTICE,
    DOC_MAX_LENGTH,
    LLM_DEFAULT_CONFIDENCE,
    LLM_MIN_CONFIDENCE,
    MSG_INJECTION,
    MSG_PII,
    NAME_RULES,
    PY_WHITESPACE,
    REPORT_MAX_ENTITIES,
    REPORT_PREVIEW_CHARS,
    RRN_WEIGHTS,
    RULES,
    SCORE_SCALE,
    VERDICT_NO_LLM_DETAILS,
    VERDICT_PARSE_ERROR_DETAILS,
    WEIGHTS,
)
from piisift.functions.dialect import split_group

A, Z = "chr(57344)", "chr(57345)"
MATCH_STRUCT = "STRUCT(span_start INTEGER, span_end INTEGER, ord INTEGER, ptype VARCHAR, value VARCHAR, confidence DOUBLE, source VARCHAR)"


def q(s: str) -> str:
    """SQL string literal (characters outside printable ASCII/Hangul via chr())."""
    parts: list[str] = []
    buf = ""
    for ch in s:
        if ch == "\n" or ch in PY_WHITESPACE and ch != " ":
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return " || ".join(parts) if len(parts) > 1 else parts[0]


WS_CHARS = q(PY_WHITESPACE)
_EXTRA_WS = [c for c in PY_WHITESPACE if c not in "\t\n\f\r "]
WS_EXTRA_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in _EXTRA_WS) + "]"


def _weight_case(col: str = "ptype") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {float(v)}" for k, v in WEIGHTS.items())
    return f"CAST(CASE {col} {whens} ELSE {float(DEFAULT_WEIGHT)} END AS DOUBLE)"


def _score(risk: str) -> str:
    return (
        f"(CASE WHEN {risk} = 0 THEN 0 ELSE CAST(least(100.0, round_even(100.0 * (1.0 - exp(-({risk}) / {SCORE_SCALE})), 0)) AS INTEGER) END)"
    )


def _luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    term = (
        "CASE WHEN i % 2 = 0 THEN (CASE WHEN TRY_CAST(x AS INTEGER) * 2 > 9 THEN TRY_CAST(x AS INTEGER) * 2 - 9 "
        "ELSE TRY_CAST(x AS INTEGER) * 2 END) ELSE TRY_CAST(x AS INTEGER) END"
    )
    return (
        f"(CASE WHEN length({d}) BETWEEN 13 AND 19 THEN "
        f"list_sum(list_transform(string_split(reverse({d}), ''), lambda x, i: {term})) % 10 = 0 ELSE false END)"
    )


def _rrn(v: str) -> str:
    d = f"replace({v}, '-', '')"
    dig = lambda i: f"TRY_CAST(substr({d}, {i + 1}, 1) AS INTEGER)"
    total = " + ".join(f"{dig(i)} * {w}" for i, w in enumerate(RRN_WEIGHTS))
    body = (
        f"TRY_CAST(substr({d}, 3, 2) AS INTEGER) BETWEEN 1 AND 12 AND TRY_CAST(substr({d}, 5, 2) AS INTEGER) BETWEEN 1 AND 31 "
        f"AND {dig(6)} IN (1, 2, 3, 4) AND (11 - ({total}) % 11) % 10 = {dig(12)}"
    )
    shape = f"strpos({v}, '-') > 0 AND length({v}) = 14 AND length({d}) = 13 AND regexp_full_match({d}, '[0-9]{{13}}')"
    return f"(CASE WHEN {shape} THEN ({body}) ELSE false END)"


def _account_ok(v: str) -> str:
    return f"(length(regexp_replace({v}, '[^0-9]', '', 'g')) >= 10)"


def _not_listed(lists: dict[str, list[str]] | None) -> str:
    if not lists:
        return "true"
    conds = []
    for kind, ptype in ALLOWLIST_KINDS.items():
        vals = lists.get(kind) or []
        if vals:
            conds.append(f"NOT (ptype = {q(ptype)} AND value IN ({', '.join(q(x) for x in vals)}))")
    return " AND ".join(conds) if conds else "true"


class Sql:
    """Accumulates named CTEs; ``render(final)`` gives the statement."""

    def __init__(self) -> None:
        self.ctes: list[tuple[str, str]] = []
        self.names: set[str] = set()

    def add(self, name: str, body: str) -> str:
        if name not in self.names:
            self.ctes.append((name, body))
            self.names.add(name)
        return name

    def render(self, final: str) -> str:
        return "WITH " + ",\n".join(f"{n} AS (\n{b}\n)" for n, b in self.ctes) + "\n" + final

    # -- inputs ---------------------------------------------------------------

    def corpus(self) -> str:
        return self.add("corpus", "SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents")

    def turns(self, role: str | None = None) -> str:
        name = f"turns_{role or 'all'}"
        where = f"WHERE role = {q(role)}" if role else ""
        return self.add(
            name,
            f"SELECT 'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS doc_id, text FROM conversations {where}",
        )

    @staticmethod
    def _pad(expr: str, n: int) -> str:
        return f"lpad(CAST({expr} AS VARCHAR), {n}, '0')"

    def customers(self) -> str:
        p, k = self._pad, "c_custkey"
        surnames = "[" + ", ".join(q(x) for x in ("김", "이", "박", "최", "정")) + "]"
        text = " || ".join(
            [
                q("성함은 "), f"({surnames})[{k} % 5 + 1]", q("민수님, "),
                q("고객번호: C"), p(k, 6), q(" 연락처 010-"), p(f"{k} % 10000", 4), "'-'", p(f"{k} * 7 % 10000", 4),
                q(", 이메일 "), "lower(replace(c_name, '#', '.'))", "'@example.com'",
                q(", 계좌번호 "), p(f"{k} % 1000", 3), "'-'", p("c_nationkey", 2), "'-'", p(f"{k} * 37 % 1000000", 6),
                q(", 카드 4"), p(f"{k} * 7919 % 1000000000000000", 15), q(" 코드 KR"), p(k, 6),
            ]
        )
        return self.add("customers", f"SELECT 'cust-' || CAST({k} AS VARCHAR) AS doc_id, {text} AS text FROM customer")

    def orders(self) -> str:
        p = self._pad
        text = " || ".join(
            [
                q("주민 "), "strftime(o_orderdate, '%y%m%d')", "'-'", "CAST(o_custkey % 4 + 1 AS VARCHAR)",
                p("o_orderkey % 100000", 5), "CAST(o_custkey % 10 AS VARCHAR)", q(" 확인"),
            ]
        )
        return self.add("orders_t", f"SELECT 'ord-' || CAST(o_orderkey AS VARCHAR) AS doc_id, {text} AS text FROM orders")

    def suppliers(self) -> str:
        p, k = self._pad, "s_suppkey"
        text = " || ".join(
            [
                q("연락처 010-"), p(f"{k} % 10000", 4), "'-'", p(f"{k} * 7 % 10000", 4),
                q(" 사무실 02-"), p(f"{k} % 1000", 3), "'-'", p(f"{k} * 13 % 10000", 4),
            ]
        )
        return self.add("suppliers_t", f"SELECT 'supp-' || CAST({k} AS VARCHAR) AS doc_id, {text} AS text FROM supplier")

    def parts(self) -> str:
        p, k = self._pad, "p_partkey"
        cities = "[" + ", ".join(q(x) for x in ("서울시", "부산시", "대전시", "제주도")) + "]"
        streets = "[" + ", ".join(q(x) for x in ("중앙로", "역삼동", "해운대길", "연동")) + "]"
        text = " || ".join(
            [f"({cities})[{k} % 4 + 1]", "' '", f"({streets})[{k} * 7 % 4 + 1]", "' '", "CAST(p_size AS VARCHAR)", q("번지 우편 "), p(f"{k} % 100000", 5)]
        )
        return self.add("parts_t", f"SELECT 'part-' || CAST({k} AS VARCHAR) AS doc_id, {text} AS text FROM part")

    def all_texts(self) -> str:
        srcs = [
            f"SELECT doc_id, text FROM {self.corpus()}",
            f"SELECT doc_id, text FROM {self.turns()}",
            f"SELECT 'page-' || CAST(page_id AS VARCHAR) AS doc_id, html AS text FROM pages",
            f"SELECT doc_id, text FROM {self.customers()}",
            f"SELECT doc_id, text FROM {self.orders()}",
            f"SELECT doc_id, text FROM {self.suppliers()}",
            f"SELECT doc_id, text FROM {self.parts()}",
        ]
        return self.add("all_texts", "\nUNION ALL\n".join(srcs))

    def extended_allow(self) -> str:
        p = self._pad
        f0 = " UNION ALL ".join(f"SELECT {q(kind)} AS kind, {q(v)} AS value" for kind, vals in DEFAULT_ALLOWLIST.items() for v in vals)
        body = f"""
{f0}
UNION ALL SELECT 'phones', '010-' || {p('c_custkey % 10000', 4)} || '-' || {p('c_custkey * 7 % 10000', 4)} FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'emails', lower(replace(c_name, '#', '.')) || '@example.com' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'phones', '010-' || {p('s_suppkey % 10000', 4)} || '-' || {p('s_suppkey * 7 % 10000', 4)} FROM supplier WHERE s_acctbal < 0"""
        return self.add("ext_allow", body)

    def large_allow(self) -> str:
        p, serial = self._pad, "(l_orderkey * 10 + l_linenumber)"
        body = f"""SELECT * FROM {self.extended_allow()}
UNION ALL SELECT 'phones', '010-' || {p('l_orderkey % 10000', 4)} || '-' || {p('l_orderkey * 7 % 10000', 4)} FROM lineitem
UNION ALL SELECT 'phones', '011-' || {p(f'{serial} // 10000 % 10000', 4)} || '-' || {p(f'{serial} % 10000', 4)} FROM lineitem
UNION ALL SELECT 'emails', 'customer.' || {p(serial, 9)} || '@example.com' FROM lineitem
UNION ALL SELECT 'accounts', {p('l_orderkey % 1000', 3)} || '-' || {p('l_linenumber', 2)} || '-' || {p('l_orderkey * 37 % 1000000', 6)} FROM lineitem"""
        return self.add("large_allow", body)

    def extended_allow_lists(self, large: bool = False) -> str:
        kinds = " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in ALLOWLIST_KINDS.items())
        return self.add("ext_allow_typed", f"SELECT DISTINCT CASE kind {kinds} END AS ptype, value FROM {self.large_allow() if large else self.extended_allow()}")

    # -- detection --------------------------------------------------------------

    def candidates(
        self,
        src: str,
        tag: str,
        types: set[str] | None = None,
        validate: bool = True,
        allowlist: dict[str, list[str]] | None = DEFAULT_ALLOWLIST,
        names: bool = False,
    ) -> str:
        """Long-form candidates ``(doc_id, ord, ptype, value, span_start, span_end, confidence, source)``."""
        rules = list(RULES)
        if names:
            cut = max(i for i, r in enumerate(RULES) if r[0] == "ACCOUNT") + 1
            rules = RULES[:cut] + NAME_RULES + RULES[cut:]
        prep = self.add(
            f"{tag}_prep",
            f"""SELECT doc_id, text, ws,
  regexp_replace(regexp_replace(ws, '[^\\P{{L}}\\x00-\\x7F]', '_', 'g'), '[^\\P{{N}}\\x00-\\x7F]', '_', 'g') AS wb
FROM (SELECT doc_id, text,
  regexp_replace(translate(text, {A} || {Z}, chr(65533) || chr(65533)), '{WS_EXTRA_CLASS}', ' ', 'g') AS ws
  FROM {src})""",
        )
        marked = []
        for ordinal, (ptype, pattern, conf, group) in enumerate(rules):
            if types is not None and ptype not in types:
                continue
            col = "wb" if "\\b" in pattern else "ws"
            if group:
                before, grp, after = split_group(pattern)
                pat, repl = f"({before})({grp})({after})", f"'\\1' || {A} || '\\2' || {Z} || '\\3'"
            else:
                pat, repl = pattern, f"{A} || '\\0' || {Z}"
            marked.append(
                f"SELECT doc_id, text, {ordinal} AS ord, {q(ptype)} AS ptype, {conf} AS confidence, "
                f"string_split(regexp_replace({col}, {q(pat)}, {repl}, 'g'), {Z}) AS segs FROM {prep}"
            )
        m = self.add(f"{tag}_marked", "\nUNION ALL\n".join(marked))
        segs = self.add(
            f"{tag}_segs",
            f"SELECT doc_id, text, ord, ptype, confidence, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i, len(segs) AS n FROM {m}",
        )
        spans = self.add(
            f"{tag}_spans",
            f"""SELECT doc_id, text, ord, ptype, confidence,
  CAST(sum(length(seg) - 1) OVER (PARTITION BY doc_id, ord ORDER BY i ROWS UNBOUNDED PRECEDING) AS INTEGER) AS span_end,
  CAST(length(seg) - strpos(seg, {A}) AS INTEGER) AS mlen
FROM {segs} WHERE i < n""",
        )
        vals = self.add(
            f"{tag}_vals",
            f"""SELECT doc_id, CAST(ord AS INTEGER) AS ord, ptype,
  CASE WHEN ptype = 'CARD' THEN trim(substring(text, span_end - mlen + 1, mlen), {WS_CHARS}) ELSE substring(text, span_end - mlen + 1, mlen) END AS value,
  span_end - mlen AS span_start, span_end, CAST(confidence AS DOUBLE) AS confidence, 'regex' AS source
FROM {spans}""",
        )
        conds = []
        if validate:
            conds.append(
                f"(CASE ptype WHEN 'CARD' THEN {_luhn('value')} WHEN 'RRN' THEN {_rrn('value')} "
                f"WHEN 'ACCOUNT' THEN {_account_ok('value')} ELSE true END)"
            )
        conds.append(_not_listed(allowlist))
        return self.add(f"{tag}_cands", f"SELECT * FROM {vals} WHERE {' AND '.join(conds)}")

    def merged(self, cands: str, tag: str) -> str:
        """Merged matches, long form with ``pos`` (0-based rank in the text)."""
        lists = self.add(
            f"{tag}_mlists",
            f"""SELECT doc_id, list_reduce(
  list_sort(list(struct_pack(span_start := span_start, span_end := span_end, ord := ord, ptype := ptype, value := value, confidence := confidence, source := source))),
  lambda acc, m: CASE WHEN len(acc) = 0 OR m.span_start >= acc[len(acc)].span_end THEN list_append(acc, m)
                      WHEN m.confidence > acc[len(acc)].confidence THEN list_append(list_slice(acc, 1, len(acc) - 1), m)
                      ELSE acc END,
  []::{MATCH_STRUCT}[]) AS ms
FROM {cands} GROUP BY doc_id""",
        )
        return self.add(
            f"{tag}_merged",
            f"""SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, m.span_start AS span_start, m.span_end AS span_end, m.ord AS ord,
  m.ptype AS ptype, m.value AS value, m.confidence AS confidence, m.source AS source
FROM {lists} l, unnest(l.ms) WITH ORDINALITY AS t(m, pos)""",
        )

    def scores(self, src: str, merged: str, tag: str) -> str:
        """Per text of ``src``: n_matches, risk, pii_score (0 when no match)."""
        return self.add(
            f"{tag}_scores",
            f"""SELECT s.doc_id, CAST(coalesce(a.n, 0) AS INTEGER) AS n_matches, coalesce(a.risk, 0.0) AS risk,
  {_score('coalesce(a.risk, 0.0)')} AS pii_score
FROM {src} s LEFT JOIN (SELECT doc_id, count(*) AS n, sum({_weight_case()}) AS risk FROM {merged} GROUP BY doc_id) a USING (doc_id)""",
        )

    def masked(self, src: str, merged: str, tag: str) -> str:
        pieces = self.add(
            f"{tag}_pieces",
            f"""SELECT m.doc_id, m.pos, m.span_end,
  substring(s.text, coalesce(lag(m.span_end) OVER w, 0) + 1, m.span_start - coalesce(lag(m.span_end) OVER w, 0)) || '<' || m.ptype || '>' AS piece
FROM {merged} m JOIN {src} s USING (doc_id)
WINDOW w AS (PARTITION BY m.doc_id ORDER BY m.pos)""",
        )
        return self.add(
            f"{tag}_masked",
            f"""SELECT s.doc_id, CASE WHEN a.doc_id IS NULL THEN s.text ELSE a.body || substring(s.text, a.last_end + 1) END AS masked
FROM {src} s LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS body, max(span_end) AS last_end FROM {pieces} GROUP BY doc_id) a USING (doc_id)""",
        )

    def guarded(self, src: str, tag: str, verdicts: str | None = None, cands: str | None = None) -> str:
        """Guard result per text: answer, pii_score, blocked, n_matches, injection, details."""
        c = cands or self.candidates(src, tag)
        m = self.merged(c, tag)
        sc = self.scores(src, m, tag)
        mk = self.masked(src, m, tag)
        if verdicts:
            vjoin = f"LEFT JOIN {verdicts} v USING (doc_id)"
            inj = "coalesce(v.injection_detected, false)"
            det = f"coalesce(v.details, {q(VERDICT_NO_LLM_DETAILS)})"
        else:
            vjoin, inj, det = "", "false", q(VERDICT_NO_LLM_DETAILS)
        return self.add(
            f"{tag}_guard",
            f"""SELECT s.doc_id,
  CASE WHEN s.text IS NULL THEN NULL WHEN {inj} THEN {q(MSG_INJECTION)} WHEN sc.pii_score >= {BLOCK_THRESHOLD} THEN {q(MSG_PII)} ELSE mk.masked END AS answer,
  sc.pii_score, CASE WHEN s.text IS NULL THEN false ELSE (sc.pii_score >= {BLOCK_THRESHOLD} OR {inj}) END AS blocked,
  sc.n_matches, {inj} AS injection_detected, {det} AS details
FROM {src} s JOIN {sc} sc USING (doc_id) JOIN {mk} mk USING (doc_id) {vjoin}""",
        )

    # -- model answers ----------------------------------------------------------

    @staticmethod
    def _clean(r: str) -> str:
        return (
            f"(CASE WHEN starts_with({r}, '```json') THEN trim(replace(replace({r}, '```json', ''), '```', ''), {WS_CHARS}) "
            f"WHEN starts_with({r}, '```') THEN trim(replace({r}, '```', ''), {WS_CHARS}) ELSE {r} END)"
        )

    def pii_responses(self) -> str:
        word = "regexp_extract(text, '[A-Za-z]{4,}', 0)"
        start = f"CAST(strpos(text, {word}) - 1 AS VARCHAR)"
        end = f"CAST(strpos(text, {word}) - 1 + length({word}) AS VARCHAR)"

        def item(kind: str, first: str, last: str, more: str) -> str:
            return f"""('{{"type": "{kind}", "value": "' || {word} || '", "start": ' || {first} || ', "end": ' || {last} || '{more}}}')"""

        def answer(*items: str) -> str:
            return """('{"pii_detected": [' || """ + " || ', ' || ".join(items) + " || ']}')"

        good = item("name", start, end, ', "confidence": 0.8')
        full = answer(good, """'{"type": "email", "value": "x", "confidence": 0.2}'""")
        partial = f"""('{{"pii_detected": [{{"type": "id_number", "value": "' || {word} || '", "start": ' || {start} || '}}]}}')"""
        shapes = [
            full,
            f"'```json' || chr(10) || {full} || chr(10) || '```'",
            f"'```' || chr(10) || {partial} || chr(10) || '```'",
            "'Sorry, no JSON here'",
            f"replace({full}, chr(34), chr(39))",
            f"{full} || ' Hope this helps.'",
            answer(item("name", f"{start} || '.0'", f"{end} || '.0'", ', "confidence": 0.8')),
            answer(item("name", f"chr(34) || {start} || chr(34)", end, ""), item("phone", start, end, "")),
            answer(item("name", start, end, ', "confidence": null'), item("address", start, end, ', "confidence": 0.7')),
            answer("""'"oops"'""", good),
            answer(item("account", start, end, ', "confidence": "high"'), good),
            answer(item("card", start, end, ', "confidence": 1')),
        ]
        cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes))
        key = "'doc-' || CAST(doc_id AS VARCHAR) AS doc_id"
        body = f"""SELECT {key}, 1 AS answer_no, CASE doc_id % {len(shapes)} {cases} END AS response FROM documents
UNION ALL SELECT {key}, 2, {partial} FROM documents WHERE doc_id % 5 = 0"""
        return self.add("pii_resp", body)

    def llm_found(self, texts: str | None = None, where: str | None = None) -> str:
        """Normalised model findings ``(doc_id, i, ...)``; ``i`` numbers a text's findings in answer order."""
        resp = self.pii_responses()
        if where:
            resp = self.add("pii_some", f"SELECT * FROM {resp} WHERE {where}")
        corpus = texts or self.corpus()
        items = self.add(
            "llm_items",
            f"""SELECT doc_id, answer_no, CASE WHEN json_valid(clean) THEN CASE WHEN json_type(clean) = 'OBJECT' AND json_type(clean, '$.pii_detected') = 'ARRAY'
  THEN json_extract(clean, '$.pii_detected[*]') END END AS items
FROM (SELECT doc_id, answer_no, {self._clean('response')} AS clean FROM {resp})""",
        )
        norm = self.add(
            "llm_norm",
            f"""SELECT doc_id, answer_no, i, upper(coalesce(json_extract_string(it, '$.type'), '')) AS ptype, coalesce(json_extract_string(it, '$.value'), '') AS value,
  coalesce(TRY_CAST(json_extract_string(it, '$.start') AS BIGINT), 0) AS s,
  coalesce(TRY_CAST(json_extract_string(it, '$.end') AS BIGINT), length(coalesce(json_extract_string(it, '$.value'), ''))) AS e,
  coalesce(TRY_CAST(json_extract_string(it, '$.confidence') AS DOUBLE), {LLM_DEFAULT_CONFIDENCE}) AS confidence
FROM {items} l, unnest(l.items) WITH ORDINALITY AS t(it, i)
WHERE len(list_filter(l.items, lambda x: json_type(x) <> 'OBJECT')) = 0
  AND coalesce(json_type(it, '$.type'), 'VARCHAR') = 'VARCHAR' AND coalesce(json_type(it, '$.value'), 'VARCHAR') = 'VARCHAR'
  AND coalesce(json_type(it, '$.start'), 'BIGINT') IN ('UBIGINT', 'BIGINT') AND coalesce(json_type(it, '$.end'), 'BIGINT') IN ('UBIGINT', 'BIGINT')
  AND coalesce(json_type(it, '$.confidence'), 'DOUBLE') IN ('UBIGINT', 'BIGINT', 'DOUBLE')""",
        )
        return self.add(
            "llm_found",
            f"""SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY answer_no, i) - 1 AS INTEGER) AS i, ptype, value,
  CAST(s AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end, CAST(confidence AS DOUBLE) AS confidence
FROM {norm} n JOIN {corpus} c ON c.doc_id = n.doc_id
WHERE ptype <> '' AND value <> '' AND confidence > {LLM_MIN_CONFIDENCE} AND s >= 0 AND s < e AND e <= length(c.text)""",
        )

    def injection_responses(self) -> str:
        flagged = "CAST(length(text) % 3 = 0 AS VARCHAR)"
        plain = f"""('{{"injection_detected": ' || {flagged} || ', "attack_types": ["JAILBREAK", "ROLE_MANIPULATION"], "confidence": 0.9, "details": "pattern"}}')"""
        shapes = [
            plain,
            """'```json' || chr(10) || '{"injection_detected": false, "attack_types": [], "confidence": 0.1, "details": "clean"}' || chr(10) || '```'""",
            "'model error {'",
            f"replace({plain}, chr(34), chr(39))",
            f"{plain} || ' That is all.'",
            """'{"injection_detected": "true", "confidence": "0.9", "details": 7}'""",
            """'{"injection_detected": 1, "confidence": 1}'""",
            """'{"injection_detected": null, "confidence": null}'""",
        ]
        cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes))
        key = "'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS doc_id"
        body = f"""SELECT {key}, 1 AS answer_no, CASE (conv_id + turn) % {len(shapes)} {cases} END AS response FROM conversations WHERE role = 'user'
UNION ALL SELECT {key}, 2, '~clean' FROM conversations WHERE role = 'user' AND conv_id % 4 = 0"""
        return self.add("inj_resp", body)

    def verdicts(self) -> str:
        r = self.injection_responses()
        each = self.add(
            "verdict_each",
            f"""SELECT doc_id, answer_no, CASE WHEN json_valid(clean) THEN CASE WHEN json_type(clean) = 'OBJECT' THEN clean END END AS j
FROM (SELECT doc_id, answer_no, {self._clean('response')} AS clean FROM {r})""",
        )
        flag = "json_extract_string(j, '$.injection_detected')"
        parsed = self.add(
            "verdict_parsed",
            f"""SELECT doc_id, answer_no, j IS NULL AS broken,
  coalesce(CASE json_type(j, '$.injection_detected') WHEN 'BOOLEAN' THEN {flag} = 'true' WHEN 'VARCHAR' THEN {flag} <> '' WHEN 'NULL' THEN false
    WHEN 'ARRAY' THEN {flag} <> '[]' WHEN 'OBJECT' THEN {flag} <> '{{}}' ELSE TRY_CAST({flag} AS DOUBLE) <> 0 END, false) AS injection_detected,
  CASE WHEN json_type(j, '$.attack_types') = 'ARRAY' THEN array_to_string(from_json(json_extract(j, '$.attack_types'), '["VARCHAR"]'), ',') ELSE '' END AS attack_types,
  CASE WHEN json_type(j, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) ELSE 0.0 END AS confidence,
  CASE WHEN j IS NULL THEN {q(VERDICT_PARSE_ERROR_DETAILS)} WHEN json_type(j, '$.details') = 'VARCHAR' THEN json_extract_string(j, '$.details') ELSE '' END AS details
FROM {each}""",
        )
        return self.add(
            "verdicts",
            f"""SELECT doc_id, injection_detected, attack_types, confidence, details FROM {parsed}
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN injection_detected THEN 0 WHEN broken THEN 2 ELSE 1 END, answer_no) = 1""",
        )

    # -- documents from pages ---------------------------------------------------

    def assembled(self, cap: int | None = None) -> str:
        corpus = self.corpus()
        pages = self.add(
            "pages_t",
            f"SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM {corpus}",
        )
        notice = q(DOC_CAP_NOTICE)
        return self.add(
            "assembled",
            f"""SELECT doc_id, {f"CASE WHEN length(j) > {cap} THEN substring(j, 1, {cap}) || {notice} ELSE j END" if cap else "j"} AS text
FROM (SELECT doc_id, string_agg({q('[페이지 ')} || CAST(page_no AS VARCHAR) || ']' || chr(10) || text || chr(10), chr(10) ORDER BY page_no) AS j
      FROM {pages} WHERE text IS NOT NULL AND text <> '' GROUP BY doc_id)""",
        )

    def entities(self, merged: str, tag: str) -> str:
        return self.add(
            f"{tag}_ents",
            f"""SELECT doc_id, CAST(rank AS INTEGER) AS rank, ptype, value FROM (
  SELECT e.doc_id, e.ptype, e.value, row_number() OVER (PARTITION BY e.doc_id ORDER BY t.tfirst, e.efirst) AS rank
  FROM (SELECT doc_id, ptype, value, min(pos) AS efirst FROM {merged} GROUP BY ALL) e
  JOIN (SELECT doc_id, ptype, min(pos) AS tfirst FROM {merged} GROUP BY ALL) t USING (doc_id, ptype))
WHERE rank <= {REPORT_MAX_ENTITIES}""",
        )


CAND_SELECT = "SELECT doc_id, ord AS rule, ptype, value, span_start, span_end, confidence FROM {c}"
MATCH_SELECT = "SELECT doc_id, pos, ptype, value, span_start, span_end, confidence, source FROM {m}"


def _detect_sql(ptype: str) -> str:
    s = Sql()
    c = s.candidates(s.all_texts(), "d", types={ptype})
    return s.render(CAND_SELECT.format(c=c))


def _name_sql() -> str:
    s = Sql()
    c = s.candidates(s.all_texts(), "d", types={"NAME"}, names=True)
    return s.render(CAND_SELECT.format(c=c))


def _luhn_sql() -> str:
    s = Sql()
    c = s.candidates(s.all_texts(), "d", types={"CARD"}, validate=False)
    return s.render(
        f"""SELECT doc_id, span_start, span_end, value, CAST(length(regexp_replace(value, '[^0-9]', '', 'g')) AS INTEGER) AS n_digits,
  {_luhn('value')} AS luhn_ok FROM {c}"""
    )


def _whitelist_filter_sql() -> str:
    s = Sql()
    c = s.candidates(s.all_texts(), "d", types={"PHONE", "EMAIL", "ACCOUNT"}, allowlist=None)
    a = s.extended_allow_lists()
    return s.render(
        f"SELECT doc_id, ord AS rule, ptype, value, span_start, span_end, confidence FROM {c} x "
        f"WHERE NOT EXISTS (SELECT 1 FROM {a} a WHERE a.ptype = x.ptype AND a.value = x.value)"
    )


def _merge_sql() -> str:
    s = Sql()
    m = s.merged(s.candidates(s.all_texts(), "d"), "d")
    return s.render(MATCH_SELECT.format(m=m))


def _merge_long_sql() -> str:
    s = Sql()
    c = s.candidates(s.all_texts(), "d")
    move = "CAST(split_part(doc_id, '-', 2) AS INTEGER) * 120"
    moved = s.add(
        "moved",
        f"""SELECT * FROM {c} WHERE NOT starts_with(doc_id, 'cust-')
UNION ALL SELECT * REPLACE ('register' AS doc_id, span_start + {move} AS span_start, span_end + {move} AS span_end) FROM {c} WHERE starts_with(doc_id, 'cust-')""",
    )
    m = s.merged(moved, "l")
    return s.render(f"SELECT doc_id, span_start, span_end, ord AS rule, ptype, value, confidence FROM {m}")


def _type_counts_sql() -> str:
    s = Sql()
    m = s.merged(s.candidates(s.all_texts(), "d"), "d")
    return s.render(f"SELECT ptype, CAST(count(*) AS BIGINT) AS n_matches, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM {m} GROUP BY ptype")


def _risk_sql() -> str:
    s = Sql()
    src = s.all_texts()
    sc = s.scores(src, s.merged(s.candidates(src, "d"), "d"), "d")
    return s.render(f"SELECT doc_id, n_matches, round(risk, 4) AS risk, pii_score FROM {sc}")


def _mask_sql() -> str:
    s = Sql()
    src = s.all_texts()
    mk = s.masked(src, s.merged(s.candidates(src, "d"), "d"), "d")
    return s.render(f"SELECT doc_id, masked FROM {mk}")


def _scrub_sql() -> str:
    s = Sql()
    src = s.add("corpus_t", f"SELECT doc_id, text FROM {s.corpus()}")
    m = s.merged(s.candidates(src, "d"), "d")
    mk = s.masked(src, m, "d")
    sc = s.scores(src, m, "d")
    return s.render(f"SELECT mk.doc_id, mk.masked AS scrubbed, sc.n_matches FROM {mk} mk JOIN {sc} sc USING (doc_id)")


def _scrub_allowlisted_sql(large: bool = False) -> str:
    s = Sql()
    src = s.all_texts()
    raw = s.candidates(src, "a", allowlist=None)
    a = s.extended_allow_lists(large)
    kept = s.add("a_kept", f"SELECT * FROM {raw} c WHERE NOT EXISTS (SELECT 1 FROM {a} x WHERE x.ptype = c.ptype AND x.value = c.value)")
    m = s.merged(kept, "ak")
    mk = s.masked(src, m, "ak")
    sc = s.scores(src, m, "ak")
    return s.render(f"SELECT mk.doc_id, mk.masked AS scrubbed, sc.n_matches FROM {mk} mk JOIN {sc} sc USING (doc_id)")


def _guard_sql() -> str:
    s = Sql()
    g = s.guarded(s.all_texts(), "g")
    return s.render(f"SELECT doc_id, answer, pii_score, blocked, n_matches, injection_detected, details FROM {g}")


def _wire_matches(s: Sql, m: str, tag: str) -> str:
    """Per text the JSON list of its matches in the response's shape."""
    one = "{'type': ptype, 'value': value, 'span': [span_start, span_end], 'confidence': confidence, 'source': source}"
    return s.add(f"{tag}_wire", f"SELECT doc_id, '[' || string_agg(CAST(to_json({one}) AS VARCHAR), ',' ORDER BY pos) || ']' AS ms FROM {m} GROUP BY doc_id")


def _guard_response_sql() -> str:
    s = Sql()
    src = s.all_texts()
    c = s.candidates(src, "g")
    w = _wire_matches(s, s.merged(c, "w"), "w")
    g = s.guarded(src, "g", cands=c)
    verdict = f"""'{{"injection_detected":false,"attack_types":[],"confidence":0.0,"details":"' || {q(VERDICT_NO_LLM_DETAILS)} || '"}}'"""
    return s.render(
        f"""SELECT g.doc_id, '{{"answer":' || CAST(to_json(g.answer) AS VARCHAR) || ',"pii_score":' || CAST(g.pii_score AS VARCHAR) || ',"blocked":' || CAST(g.blocked AS VARCHAR)
  || ',"matches":' || coalesce(w.ms, '[]') || ',"prompt_injection":' || {verdict} || '}}' AS response
FROM {g} g LEFT JOIN {w} w USING (doc_id)"""
    )


def _scrub_response_sql() -> str:
    s = Sql()
    src = s.all_texts()
    m = s.merged(s.candidates(src, "d"), "d")
    w = _wire_matches(s, m, "w")
    mk = s.masked(src, m, "d")
    return s.render(
        f"""SELECT mk.doc_id, '{{"scrubbed":' || CAST(to_json(mk.masked) AS VARCHAR) || ',"matches":' || coalesce(w.ms, '[]') || '}}' AS response
FROM {mk} mk LEFT JOIN {w} w USING (doc_id)"""
    )


def _stream_guard_sql() -> str:
    s = Sql()
    src = s.add("corpus_t", f"SELECT doc_id, text FROM {s.corpus()}")
    g = s.guarded(src, "g")
    return s.render(f"SELECT doc_id, answer, pii_score, blocked, n_matches FROM {g}")


def _stream_hybrid_sql() -> str:
    s = Sql()
    src = s.add("corpus_t", f"SELECT doc_id, text FROM {s.corpus()}")
    c = _hybrid_candidates(s, src, s.llm_found(src, "CAST(split_part(doc_id, '-', 2) AS BIGINT) % 4 <> 0"))
    key, hit = "'doc-' || CAST(doc_id AS VARCHAR) AS doc_id", "doc_id % 2 = 0"
    v = s.add("doc_verdicts", f"SELECT {key}, {hit} AS injection_detected, CASE WHEN {hit} THEN 'pattern' ELSE '' END AS details FROM documents WHERE doc_id % 3 = 0")
    g = s.guarded(src, "g", verdicts=v, cands=c)
    return s.render(f"SELECT doc_id, answer, pii_score, blocked, n_matches, details FROM {g}")


def _block_reasons_sql() -> str:
    s = Sql()
    src = s.add("reasons_in", f"SELECT doc_id, text FROM {s.turns()} UNION ALL SELECT doc_id, text FROM {s.customers()}")
    g = s.guarded(src, "g", verdicts=s.verdicts())
    reason = "CASE WHEN injection_detected THEN 'injection' WHEN blocked THEN 'pii' ELSE 'none' END"
    return s.render(
        f"SELECT {reason} AS reason, CAST(count(*) AS BIGINT) AS n_texts, CAST(sum(n_matches) AS BIGINT) AS n_matches, max(pii_score) AS max_score FROM {g} GROUP BY 1"
    )


def _llm_parse_sql() -> str:
    s = Sql()
    f = s.llm_found()
    return s.render(
        f"SELECT doc_id, i AS idx, ptype, value, span_start, span_end, confidence FROM {f}"
    )


def _hybrid_candidates(s: Sql, src: str, found: str | None = None) -> str:
    c = s.candidates(src, "d")
    f = found or s.llm_found()
    return s.add(
        "hybrid_cands",
        f"SELECT doc_id, ord, ptype, value, span_start, span_end, confidence, source FROM {c} "
        f"UNION ALL SELECT doc_id, CAST(1000 + i AS INTEGER), ptype, value, span_start, span_end, confidence, 'llm' FROM {f}",
    )


def _llm_hybrid_sql() -> str:
    s = Sql()
    src = s.add("corpus_t", f"SELECT doc_id, text FROM {s.corpus()}")
    return s.render(MATCH_SELECT.format(m=s.merged(_hybrid_candidates(s, src), "h")))


def _hybrid_scrub_sql() -> str:
    s = Sql()
    src = s.add("corpus_t", f"SELECT doc_id, text FROM {s.corpus()}")
    m = s.merged(_hybrid_candidates(s, src), "h")
    mk = s.masked(src, m, "h")
    sc = s.scores(src, m, "h")
    return s.render(f"SELECT mk.doc_id, mk.masked AS scrubbed, sc.n_matches FROM {mk} mk JOIN {sc} sc USING (doc_id)")


def _hybrid_guard_sql() -> str:
    s = Sql()
    src = s.add("hybrid_in", f"SELECT doc_id, text FROM {s.corpus()} UNION ALL SELECT doc_id, text FROM {s.turns()}")
    g = s.guarded(src, "g", verdicts=s.verdicts(), cands=_hybrid_candidates(s, src))
    return s.render(f"SELECT doc_id, answer, pii_score, blocked, n_matches, injection_detected, details FROM {g}")


def _verdicts_sql() -> str:
    s = Sql()
    t = s.turns()
    v = s.verdicts()
    return s.render(
        f"""SELECT t.doc_id, coalesce(v.injection_detected, false) AS injection_detected, coalesce(v.attack_types, '') AS attack_types,
  coalesce(v.confidence, 0.0) AS confidence, coalesce(v.details, {q(VERDICT_NO_LLM_DETAILS)}) AS details
FROM {t} t LEFT JOIN {v} v USING (doc_id)"""
    )


def _assembly_sql(cap: int | None = None) -> str:
    s = Sql()
    a = s.assembled(cap)
    return s.render(f"SELECT doc_id, text, CAST(length(text) AS INTEGER) AS n_chars FROM {a}")


def _pieces_sql() -> str:
    s = Sql()
    s.assembled()
    part = f"{q('[페이지 ')} || CAST(page_no AS VARCHAR) || ']' || chr(10) || text || chr(10)"
    return s.render(
        f"""SELECT doc_id, piece, CAST(coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, part
FROM (SELECT doc_id, CAST(page_no // 4 AS BIGINT) AS piece, string_agg({part}, chr(10) ORDER BY page_no) AS part FROM pages_t WHERE text <> '' GROUP BY ALL)"""
    )


def _report_sql(cap: int | None = None, answers: bool = False) -> str:
    s = Sql()
    a = s.assembled(cap)
    if answers:
        c = _hybrid_candidates(s, a, s.llm_found(a, "CAST(split_part(doc_id, '-', 2) AS BIGINT) % 4 <> 0"))
        key, hit = "'doc-' || CAST(doc_id AS VARCHAR) AS doc_id", "doc_id % 2 = 0"
        v = s.add("doc_verdicts", f"SELECT {key}, {hit} AS injection_detected, CASE WHEN {hit} THEN 'pattern' ELSE '' END AS details FROM documents WHERE doc_id % 3 = 0")
        m = s.merged(c, "m")
        g = s.guarded(a, "r", verdicts=v, cands=c)
    else:
        m = s.merged(s.candidates(a, "r"), "r")
        g = s.guarded(a, "r")
    e = s.entities(m, "r")
    prev = f"CASE WHEN length(g.answer) > {REPORT_PREVIEW_CHARS} THEN substring(g.answer, 1, {REPORT_PREVIEW_CHARS}) || '...' ELSE g.answer END"
    return s.render(
        f"""SELECT g.doc_id, g.pii_score, g.blocked, g.n_matches AS total_matches, CAST(coalesce(x.n, 0) AS INTEGER) AS n_entities,
  coalesce(x.ents, '') AS entities, {prev} AS preview
FROM {g} g LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(ptype || '=' || value, '; ' ORDER BY rank) AS ents FROM {e} GROUP BY doc_id) x USING (doc_id)"""
    )


def _top_entities_sql() -> str:
    s = Sql()
    m = s.merged(s.candidates(s.all_texts(), "d"), "d")
    e = s.entities(m, "d")
    return s.render(f"SELECT doc_id, rank, ptype, value FROM {e}")


def _impact_body(s: Sql, src: str, tag: str, large: bool = False) -> str:
    raw = s.candidates(src, tag, allowlist=None)
    a = s.extended_allow_lists(large)
    listed_after = f"EXISTS (SELECT 1 FROM {a} a WHERE a.ptype = c.ptype AND a.value = c.value)"
    before = s.add(f"{tag}_cb", f"SELECT * FROM {raw} WHERE {_not_listed(DEFAULT_ALLOWLIST)}")
    after = s.add(f"{tag}_ca", f"SELECT * FROM {raw} c WHERE NOT {listed_after}")
    newly = s.add(f"{tag}_new", f"SELECT doc_id, count(*) AS n FROM {before} c WHERE {listed_after} GROUP BY doc_id")
    sb = s.scores(src, s.merged(before, f"{tag}b"), f"{tag}b")
    sa = s.scores(src, s.merged(after, f"{tag}a"), f"{tag}a")
    return s.add(
        f"{tag}_impact",
        f"""SELECT b.doc_id, b.n_matches AS matches_before, a.n_matches AS matches_after, b.pii_score AS score_before, a.pii_score AS score_after,
  CAST(coalesce(n.n, 0) AS INTEGER) AS newly_filtered, a.pii_score - b.pii_score AS delta
FROM {sb} b JOIN {sa} a USING (doc_id) LEFT JOIN {newly} n USING (doc_id)""",
    )


def _impact_sql(large: bool = False) -> str:
    s = Sql()
    i = _impact_body(s, s.all_texts(), "w", large)
    return s.render(f"SELECT * FROM {i}")


def _qa_sql(rows: bool = False) -> str:
    s = Sql()
    cust = s.customers()
    gc = s.guarded(cust, "qc")
    mc = s.merged(s.candidates(cust, "qc"), "qc")
    types_c = s.add(
        "qc_types",
        f"SELECT doc_id, bool_or(ptype = 'EMAIL') AS has_email, bool_or(ptype = 'ACCOUNT') AS has_account FROM {mc} GROUP BY doc_id",
    )
    mk = s.masked(cust, mc, "qc")
    t1 = (
        f"SELECT 'guard_contacts' AS suite, doc_id, CASE WHEN g.pii_score > 0 AND coalesce(t.has_email, false) AND coalesce(t.has_account, false) "
        f"AND (g.blocked OR contains(g.answer, '<EMAIL>')) THEN 'PASS' ELSE 'FAIL' END AS status FROM {gc} g LEFT JOIN {types_c} t USING (doc_id)"
    )
    t2 = (
        f"SELECT 'scrub_accounts', doc_id, CASE WHEN coalesce(t.has_account, false) AND contains(k.masked, '<ACCOUNT>') THEN 'PASS' ELSE 'FAIL' END "
        f"FROM {mk} k LEFT JOIN {types_c} t USING (doc_id)"
    )
    safe = s.guarded(s.turns("assistant"), "qs")
    t4 = f"SELECT 'guard_safe', doc_id, CASE WHEN pii_score = 0 AND n_matches = 0 THEN 'PASS' ELSE 'FAIL' END FROM {safe}"
    orders = s.orders()
    mo = s.merged(s.candidates(orders, "qo"), "qo")
    t5 = (
        f"SELECT 'guard_rrn', doc_id, CASE WHEN r.doc_id IS NULL THEN 'PASS' ELSE 'FAIL' END FROM {orders} o "
        f"LEFT JOIN (SELECT DISTINCT doc_id FROM {mo} WHERE ptype = 'RRN') r USING (doc_id)"
    )
    go = s.guarded(orders, "qo")
    t5b = f"SELECT 'guard_rrn_low_score', doc_id, CASE WHEN pii_score <= 10 THEN 'PASS' ELSE 'FAIL' END FROM {go}"
    imp = _impact_body(s, s.suppliers(), "qw")
    t6 = f"SELECT 'whitelist_after', doc_id, CASE WHEN delta <= 0 THEN 'PASS' ELSE 'FAIL' END FROM {imp}"
    res = s.add("qa_results", "\nUNION ALL\n".join([t1, t2, t4, t5, t5b, t6]))
    if rows:
        return s.render(f"SELECT suite, doc_id, status FROM {res}")
    return s.render(
        f"""SELECT suite, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) AS BIGINT) AS passed,
  CAST(count(*) - sum(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  round(100.0 * sum(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) / count(*), 1) AS pass_rate
FROM {res} GROUP BY suite"""
    )


def _expectations_sql() -> str:
    s = Sql()
    cust, orders = s.customers(), s.orders()
    m = s.merged(s.candidates(cust, "qc"), "qc")
    mk = s.masked(cust, m, "qc")
    g = s.guarded(cust, "qc")
    mo = s.merged(s.candidates(orders, "qo"), "qo")
    mail = "lower(replace(c_name, '#', '.')) || '@example.com'"
    told = s.add("told", f"SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS doc_id, {mail} AS mail, c_nationkey < 10 AS high FROM customer")
    found = f"EXISTS (SELECT 1 FROM {m} x WHERE x.doc_id = t.doc_id AND x.value = t.mail)"
    rrn = f"EXISTS (SELECT 1 FROM {mo} x WHERE x.doc_id = 'ord-' || CAST(o_orderkey AS VARCHAR) AND x.ptype = 'RRN')"
    return s.render(
        f"""SELECT 'mail_found' AS suite, t.doc_id, CASE WHEN {found} AND NOT contains(k.masked, t.mail) THEN 'PASS' ELSE 'FAIL' END AS status FROM {told} t JOIN {mk} k USING (doc_id)
UNION ALL SELECT 'blocked_as_told', t.doc_id, CASE WHEN g.blocked = t.high THEN 'PASS' ELSE 'FAIL' END FROM {told} t JOIN {g} g USING (doc_id)
UNION ALL SELECT 'rrn_as_told', 'ord-' || CAST(o_orderkey AS VARCHAR), CASE WHEN {rrn} = (o_custkey % 2 <> 0) THEN 'PASS' ELSE 'FAIL' END FROM orders"""
    )


def _requests_sql() -> str:
    key = "'doc-' || CAST(doc_id AS VARCHAR)"
    head = f"""'{{"doc_id": "' || {key} || '", """
    return f"""
        SELECT CASE WHEN k IN (0, 4) THEN NULL ELSE {key} END AS doc_id, CASE WHEN k > 4 THEN text END AS text,
            CASE k WHEN 0 THEN 'not_json' WHEN 1 THEN 'text_missing' WHEN 2 THEN 'text_not_a_string' WHEN 3 THEN 'text_not_a_string' WHEN 4 THEN 'not_an_object' END AS reject,
            CASE k WHEN 0 THEN {head}"text": ' WHEN 1 THEN {head}"body": "x"}}' WHEN 2 THEN {head}"text": null}}'
                WHEN 3 THEN {head}"text": ' || CAST(doc_id AS VARCHAR) || '}}' WHEN 4 THEN '["' || {key} || '"]' END AS body
        FROM (SELECT doc_id, text, CASE WHEN doc_id % 10 > 4 AND text IS NULL THEN 2 ELSE doc_id % 10 END AS k FROM documents)
    """


def _risk_by_source_sql() -> str:
    s = Sql()
    corpus = s.corpus()
    src = s.add("corpus_t", f"SELECT doc_id, text FROM {corpus}")
    g = s.guarded(src, "g")
    return s.render(
        f"""SELECT c.lang, c.source, CAST(count(*) AS BIGINT) AS n_docs,
  CAST(sum(CASE WHEN g.n_matches > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_with_pii,
  CAST(sum(CASE WHEN g.blocked THEN 1 ELSE 0 END) AS BIGINT) AS n_blocked,
  CAST(sum(g.n_matches) AS BIGINT) AS n_matches, max(g.pii_score) AS max_score, round(avg(g.pii_score), 4) AS avg_score
FROM {corpus} c JOIN {g} g USING (doc_id) GROUP BY c.lang, c.source"""
    )


def _stream_scrub_sql() -> str:
    return _scrub_sql()


ORACLE: dict[str, callable] = {
    "detect_phone": lambda: _detect_sql("PHONE"),
    "detect_email": lambda: _detect_sql("EMAIL"),
    "detect_card": lambda: _detect_sql("CARD"),
    "detect_rrn": lambda: _detect_sql("RRN"),
    "detect_account": lambda: _detect_sql("ACCOUNT"),
    "detect_address": lambda: _detect_sql("ADDRESS"),
    "detect_id_number": lambda: _detect_sql("ID_NUMBER"),
    "name_candidates": _name_sql,
    "luhn_filter": _luhn_sql,
    "whitelist_filter": _whitelist_filter_sql,
    "merge_spans": _merge_sql,
    "merge_spans_long": _merge_long_sql,
    "type_counts": _type_counts_sql,
    "risk_score": _risk_sql,
    "mask_documents": _mask_sql,
    "scrub_documents": _scrub_sql,
    "scrub_allowlisted": _scrub_allowlisted_sql,
    "scrub_large_allowlist": lambda: _scrub_allowlisted_sql(large=True),
    "scrub_incremental": _scrub_sql,
    "requests_read": _requests_sql,
    "guard_documents": _guard_sql,
    "guard_block_reasons": _block_reasons_sql,
    "llm_pii_parse": _llm_parse_sql,
    "llm_answers_table": _llm_parse_sql,
    "llm_hybrid_merge": _llm_hybrid_sql,
    "injection_verdicts": _verdicts_sql,
    "guard_response": _guard_response_sql,
    "scrub_response": _scrub_response_sql,
    "guard_response_all": _guard_response_sql,
    "scrub_response_all": _scrub_response_sql,
    "qa_results": lambda: _qa_sql(rows=True),
    "qa_expectations": _expectations_sql,
    "hybrid_guard": _hybrid_guard_sql,
    "hybrid_scrub": _hybrid_scrub_sql,
    "document_assembly": _assembly_sql,
    "document_assembly_capped": lambda: _assembly_sql(DOC_MAX_LENGTH),
    "document_pieces": _pieces_sql,
    "document_report": _report_sql,
    "document_report_answers": lambda: _report_sql(answers=True),
    "document_report_capped": lambda: _report_sql(DOC_MAX_LENGTH),
    "top_entities": _top_entities_sql,
    "whitelist_impact": _impact_sql,
    "whitelist_impact_large": lambda: _impact_sql(large=True),
    "qa_summary": _qa_sql,
    "risk_by_source": _risk_by_source_sql,
    "stream_guard": _stream_guard_sql,
    "stream_scrub": _stream_scrub_sql,
    "stream_guard_once": _stream_guard_sql,
    "stream_hybrid_guard": _stream_hybrid_sql,
}


def oracle_sql() -> dict[str, str]:
    return {name: fn() for name, fn in ORACLE.items()}
