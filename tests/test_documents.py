"""Page assembly, length cap, document report."""

from piisift.config import DOC_CAP_NOTICE, DOC_MAX_LENGTH
from piisift.operators.reports import document_report
from piisift.sources.texts import assemble_documents


def _assemble_py(pages, cap=10000):
    parts = [f"[페이지 {n}]\n{t}\n" for n, t in sorted(pages) if t]
    full = "\n".join(parts)
    return full[:cap] + DOC_CAP_NOTICE if len(full) > cap else full


def test_assembly_and_cap(spark):
    docs = {
        "plain": [(1, "a"), (2, ""), (3, "b")],
        "exact": [(1, "x" * (10000 - len("[페이지 1]\n\n")))],
        "over": [(1, "y" * 6000), (2, "z" * 6000), (3, "w" * 10)],
        "edge": [(1, "q" * 9985), (2, "r" * 5)],
        "many": [(i, "p" * 300) for i in range(1, 200)],
        "hot": [(i, "" if i % 7 == 0 else "h") for i in range(1, 5000)],
        "gaps": [(i * 13, "g" * (i % 5)) for i in range(1, 3000)],
    }
    rows = [(d, n, t) for d, ps in docs.items() for n, t in ps]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    for buckets in (1, 3, 64):
        got = {r.doc_id: r.text for r in assemble_documents(pages, max_length=DOC_MAX_LENGTH, salt_buckets=buckets).collect()}
        for d, ps in docs.items():
            assert got[d] == _assemble_py(ps), (d, buckets)
    whole = {r.doc_id: r.text for r in assemble_documents(pages).collect()}  # the cap is opt-in
    for d, ps in docs.items():
        assert whole[d] == _assemble_py(ps, cap=10**9), d
    assert got["plain"] == "[페이지 1]\na\n\n[페이지 3]\nb\n"
    assert len(got["exact"]) == 10000


def test_document_report(spark):
    text = "연락처 010-1234-5678 " * 30 + "메일 a@b.co 메일 a@b.co " + "x" * 500
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    r = document_report(df).collect()[0]
    assert r.total_matches == 32 and r.pii_score == 100 and r.blocked
    assert [(e.ptype, e.value) for e in r.entities] == [("PHONE", "010-1234-5678"), ("EMAIL", "a@b.co")]
    assert r.preview.endswith("...") is False  # blocked answer is the short message


def test_pieces_are_the_document(spark):
    from piisift.sources.texts import document_pieces, piece_offsets
    from pyspark.sql import functions as F

    rows = [("hot", i, "" if i % 7 == 0 else "h" * (i % 9 + 1)) for i in range(1, 3000)]
    rows += [("gaps", i * 13, "g" * (i % 5)) for i in range(1, 300)] + [("one", 1, "x"), ("none", 1, ""), ("null", 1, None), (None, 2, "b"), (None, 1, "a"), ("two", 1, "b"), ("two", 1, "a")]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string").repartition(5)
    whole = {r.doc_id: r.text for r in assemble_documents(pages).collect()}
    for size in (1, 4, 64):
        pieces = document_pieces(pages, piece_pages=size)
        got = {}
        for r in sorted(pieces.collect(), key=lambda r: r.piece):
            got.setdefault(r.doc_id, []).append((r.piece, r.part))
        assert {d: "\n".join(p for _, p in ps) for d, ps in got.items()} == whole
        at = {(r.doc_id, r.piece): (r.offset, r.chars) for r in piece_offsets(pieces, F.length("part"), group=3).collect()}
        for d, ps in got.items():
            for piece, part in ps:
                offset, chars = at[d, piece]
                assert whole[d][offset : offset + chars] == part
    assert document_pieces(pages.limit(0)).count() == 0
