"""Spark span extraction vs Python ``re.finditer`` (the dialect the rules are written in)."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fixture_texts import CASES, SAMPLE
from piisift.config import NAME_RULES, RULES, DetectorConfig
from piisift.functions.spans import match_spans, safe_text
from piisift.operators.detect import with_candidates

TRICKY = [
    "카드 4111 1111 1111 1111입니다",
    "card 4111 1111 1111 1111 end",
    "sep\x1c4111 1111 1111 1111\x1f end",
    "é4111111111111111 é 4111111111111111 ü",
    "marker  010-1234-5678  x",
    "emoji 😀 010-1234-5678 and 😀😀 a@b.co",
    "계좌\t번호: 110-123-456789 계좌번호:123-45-67890123",
    "이름은 김철수 박영희님 John Smith said",
    "서울시 강남구\n역삼동 123-4번지 06234",
    "사번:AB-1234 고객번호 C123456 ABCD12345678",
    "　 12345   67890 ",
    "",
]


def _python_spans(text, pattern, group):
    if text is None:
        return []
    return [(m.start(group), m.end(group)) for m in re.finditer(pattern, text)]


def _check(spark, rows, rules, config):
    df = spark.createDataFrame(rows, "doc_id string, text string")
    c = with_candidates(df, config=config, validate=False, allowlist=False, gates=False)
    got = {r.doc_id: r for r in c.select("doc_id", "text", "_cands").collect()}
    for doc_id, text in rows:
        cands = got[doc_id]._cands
        for ordinal, (ptype, pattern, _conf, group) in enumerate(rules):
            spark_spans = [(m.span_start, m.span_end) for m in cands if m.ord == ordinal]
            assert spark_spans == _python_spans(text, pattern, group), (doc_id, ptype, pattern)
            for m in cands:
                if m.ord == ordinal:
                    raw = text[m.span_start : m.span_end]
                    assert m.value == (raw.strip() if ptype == "CARD" else raw), (doc_id, ptype)


def test_fixture_and_tricky_texts(spark):
    rows = [(k, v[0]) for k, v in CASES.items()] + [("S", SAMPLE)] + [(f"x{i}", t) for i, t in enumerate(TRICKY)]
    cfg = DetectorConfig(name_candidates=True)
    _check(spark, rows, cfg.rules(), cfg)


@pytest.mark.parametrize("table,col", [("documents", "text"), ("pages", "html"), ("conversations", "text")])
def test_driver_tables(spark, table, col):
    df = spark.read.parquet(f"{SF_SMALL}/{table}.parquet")
    rows = [(str(i), r[0]) for i, r in enumerate(df.select(col).collect())]
    _check(spark, rows, DetectorConfig().rules(), DetectorConfig())


def test_gates_do_not_change_results(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").cast("string"), "text")
    a = with_candidates(df, gates=True).select("doc_id", "_cands").collect()
    b = with_candidates(df, gates=False).select("doc_id", "_cands").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_name_rules_are_off_by_default():
    assert all(r[0] != "NAME" for r in DetectorConfig().rules())
    on = DetectorConfig(name_candidates=True).rules()
    names = [i for i, r in enumerate(on) if r[0] == "NAME"]
    assert names and on[names[0] - 1][0] == "ACCOUNT" and on[names[-1] + 1][0] == "ADDRESS"
    assert len(on) == len(RULES) + len(NAME_RULES)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

ALPHABET = list("0123456789") * 3 + list(" -:.@_\t\n") + list("aZAbKR") + list("계좌번호사고객서울시동로가길님é") + ["\xa0", "\x1c", "　", "😀"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, min_size=0, max_size=60), min_size=1, max_size=40))
def test_random_texts_match_python_re(spark, texts):
    cfg = DetectorConfig(name_candidates=True)
    _check(spark, [(str(i), t) for i, t in enumerate(texts)], cfg.rules(), cfg)


def test_texts_with_many_matches(spark):
    import random

    rnd = random.Random(5)
    pieces = ["010-1234-5678", "4111 1111 1111 1111", " a@b.co ", "계좌번호 123-45-678901", "06234", "AB123456", "x", " ", "서울시 강남구 역삼동 "]
    rows = [(f"big{i}", "".join(rnd.choice(pieces) for _ in range(rnd.choice([40, 150, 600])))) for i in range(6)]
    cfg = DetectorConfig()
    _check(spark, rows, cfg.rules(), cfg)


def test_long_text_scrub_matches_python(spark):
    """A ~100k-character text with thousands of matches: blocked scan, island
    merge and chunked masking, checked against a direct Python rebuild."""
    import random

    from piisift.operators.guard import scrub

    rnd = random.Random(3)
    pieces = ["010-1234-5678", "4111 1111 1111 1111", " a@b.co ", "계좌번호 123-45-678901", "😀", "é", "x" * 50, " ", "\n"]
    rows = [(f"d{i}", "".join(rnd.choice(pieces) for _ in range(n))) for i, n in enumerate([300, 8000])]
    out = {r.doc_id: r for r in scrub(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for d, t in rows:
        r = out[d]
        rebuilt, pos = [], 0
        for m in r.matches:
            assert pos <= m.span_start < m.span_end
            rebuilt += [t[pos : m.span_start], f"<{m.ptype}>"]
            pos = m.span_end
        assert r.scrubbed == "".join(rebuilt) + t[pos:], d
    assert len(out["d1"].matches) > 1000


def test_email_runs_are_linear_and_equal_to_python(spark):
    """A leading run is taken whole: same spans as ``re``, also back to back, and no stall on one long run."""
    import random
    import re
    import time

    from piisift.config import RULES
    from piisift.operators.guard import scrub

    pattern = next(p for t, p, _, _ in RULES if t == "EMAIL")
    rnd = random.Random(3)
    texts = ["a@b.co1@c.de", "x.y@z.com@w.org a@b.cc", "@@a@b.cd", "a@b", "a%b+c@d-e.fg.hi!"]
    texts += ["".join(rnd.choice("ab1.@-_ é") for _ in range(rnd.randrange(4, 60))) + rnd.choice(["", "@a.bc", "@a.bc@d.ef"]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = df.select("doc_id", match_spans(safe_text(F.col("text")), pattern).alias("m")).collect()
    for r in found:
        assert [(s["s"], s["e"]) for s in r["m"]] == [m.span() for m in re.finditer(pattern, texts[r["doc_id"]])], texts[r["doc_id"]]
    long = spark.createDataFrame([(1, "a" * 1_000_000 + " @ x@y.com")], "doc_id int, text string")
    began = time.time()
    assert scrub(long).first()["scrubbed"].endswith(" @ <EMAIL>")
    assert time.time() - began < 60


def test_address_runs_are_linear_and_equal_to_python(spark):
    """One attempt per run of body characters: same spans as ``re``, and no stall without a closing suffix."""
    import random
    import time

    from piisift.operators.detect import detect

    pattern = next(p for t, p, _, _ in RULES if t == "ADDRESS")
    rnd = random.Random(4)
    texts = ["서울동", "서울시동", "서울 동", "서울  동", "서울시 동 서울", "서울서울동x부산시 1-2번지가나x", "경기도로", "서울번지", "가서울나번지다호", "서울\u3000\x1c로 제주", "서울𝟏로 부산𝟏"]
    pieces = ["서울", "부산", "제주", "시", "도", "동", "로", "가", "길", "번지", "번", "호", " ", "\n", "1", "٣", "-", "x", "é", "힣", "𝟏", "\x1c"]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 30))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in df.select("doc_id", match_spans(safe_text(F.col("text")), pattern).alias("m")).collect():
        assert [(s["s"], s["e"]) for s in r["m"]] == [m.span() for m in re.finditer(pattern, texts[r["doc_id"]])], texts[r["doc_id"]]
    long = spark.createDataFrame([(1, "서울 " * 330_000), (2, "서울 " * 330_000 + "1번지")], "doc_id int, text string").coalesce(1)
    detect(long.limit(0)).collect()
    began = time.time()
    sizes = {r["doc_id"]: r["n"] for r in detect(long).select("doc_id", F.size("matches").alias("n")).collect()}
    assert sizes == {1: 0, 2: 1} and time.time() - began < 20
