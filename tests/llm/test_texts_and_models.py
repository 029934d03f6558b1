"""Packing, mixing, extraction, classifiers and language-model scores."""

import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from odd_rows import ROWS, docs, no_docs, words_of  # noqa: F401

from piisift.llm import packing, quality, toxicity
from piisift.llm.extraction import Page, Scores, best_region, extract_text, main_text
from piisift.llm.labelled import remainder
from piisift.llm.mixing import mix_sources, mixed_documents, share_out, weights_by_rank
from piisift.llm.mixlm import MixModel, follow, score_texts, train_model

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("pool", [packing.POOL_TOKENS, 3000])
def test_packing_round_trip(docs, no_docs, monkeypatch, pool):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "POOL_TOKENS", pool)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(docs).collect()
    wanted = sorted(([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in ROWS))
    by_sequence, pieces = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"] and r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    for key, ps in pieces.items():  # repeated rows share a key: each start occurs as often as the row
        copies = len([1 for s, _ in ps if s == 0])
        assert sum(len(i) for _, i in ps) == copies * key[1]
    assert sum(r["length"] for r in rows) == sum(map(len, wanted))
    for spans in by_sequence.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 2048 and (end >= 0.97 * 2048 or end & (end - 1) == 0)
    whole = sorted(i for ps in pieces.values() if len(ps) == 1 for _, i in ps)
    assert all(w in wanted for w in whole)
    assert packing.pack_documents(no_docs).count() == 0


def test_packed_pieces_leave_in_small_batches():
    pieces = [(i, 0, np.zeros(n, dtype=np.uint32), n, 0, 0) for i, n in enumerate([2048] * 700 + [1] * 9000)]
    batches = list(packing._gathered(iter(pieces)))
    assert [p[0] for b in batches for p in b] == list(range(len(pieces)))
    assert all(len(b) <= 4096 and sum(len(p[2]) for p in b) < packing.OUT_TOKENS + packing.WINDOW for b in batches)
    assert list(packing._gathered(iter([]))) == []


def test_word_tokenizer_equals_library():
    words = packing.WordTokenizer(packing.default_tokenizer())
    texts = ["", " a", "don't<|endoftext|>x", "İstanbul ﬁ é été ÉTÉ", "'sun's 12'3 <| $$$'ll", "\x1c a\x85b", "日本語 テスト", "a‍b ß ª º × ÷", "it's I'LL we've x'y 'tis", *[r[1] or "" for r in ROWS]]
    for _ in range(2):
        ids, n = words.encode(pa.array(texts, pa.large_string()))
        ref = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for r in ref for i in [*r, 1]] and n.tolist() == [len(r) + 1 for r in ref]


def test_best_fit_takes_the_tightest_window():
    place, used = packing.best_fit_decreasing(np.array([60, 50, 45, 40, 5]), 100)
    assert place.tolist() == [0, 1, 1, 0, 1] and used.tolist() == [100, 100]


def test_share_out_reaches_a_fixed_point():
    sizes = {"a": 10, "b": 1000, "c": 0, None: 500}
    targets = share_out(sizes, weights_by_rank(list(sizes)), 1510)
    assert targets["a"] == 30.0 and targets["c"] == 0.0 and abs(sum(targets.values()) - 1510) < 1e-6
    assert all(targets[s] <= 3 * sizes[s] for s in sizes) and targets["b"] / targets[None] == pytest.approx(2 / 5)


def test_mixing(spark, docs, no_docs):
    big = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mix_sources(big).select("doc_id", "source", "size", "source_size", "target", "taken", "text").collect()
    assert len(rows) == big.count() and all(r["size"] == len(words_of(r["text"])) for r in rows)
    again = {(r["doc_id"], r["taken"]) for r in mix_sources(big.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    by = {}
    for r in rows:
        assert r["taken"] in [k * r["size"] for k in range(4)]
        s = by.setdefault(r["source"], [0, 0, r["source_size"], r["target"], 0])
        s[0] += r["size"]
        s[1] += r["taken"]
        s[4] = max(s[4], r["size"])
    for size, taken, source_size, target, longest in by.values():
        assert size == source_size and abs(taken - target) <= longest / 2 + 1
    odd = mix_sources(docs)
    assert {"lang", "n_chars", "size", "taken"} <= set(odd.columns) and odd.count() == len(ROWS)
    assert mixed_documents(docs).columns == docs.columns
    assert mix_sources(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


def test_mixing_with_clashing_columns(spark):
    rows = [(i, "w " * (i % 5 + 1), f"s{i % 2}", "keep", 99, [1], 5, -1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string, size int, bands array<int>, copies int, _h int")
    mixed = mix_sources(df)
    assert set(mixed.columns) == {*df.columns, "source_size", "target"} and all(r["size"] == r["doc_id"] % 5 + 1 and r["bands"] == [1] for r in mixed.collect())
    out = mixed_documents(df).collect()
    assert out and all((r["taken"], r["size"], r["copies"], r["_h"]) == ("keep", 99, 5, -1) for r in out)


def test_mixing_meets_targets_beside_a_long_document(spark):
    """Half of a source is one document: targets that need it, or need it left out, are met all the same."""
    for seed in range(3):
        rows = [(i + 5000 * seed, "w " * 50, "a") for i in range(400)] + [(9000 + seed, "w " * 20_000, "a"), (9100 + seed, "w " * 30_000, "b")]
        for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect():
            nearest = 25 if r["source"] == "a" else 15_000
            assert abs(r["n"] - r["t"]) <= nearest + 1


def test_best_region():
    assert best_region([-1.0, 2.0, -1.0, 3.0, -5.0, 4.0]) == (1, 4) and best_region([-1.0]) == (0, 0) == best_region([])


def test_main_text():
    scores = Scores({"p": (10_000, 10), "h1": (500, 5)}, (600, 20))
    page = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies <b>ok</b></div><header><h1>Site</h1>
    <nav><a href=x>Home</a></nav></header><div id=content><h2>Title &amp; more</h2><script>var t="</p>";</script><p>First  para with some
    words that are many<p>Second <i>para</i>graph with <a href="x">a link</a> in it<ul><li>one<li>two</ul><form><input> send</form></div>
    <aside>Related</aside><div class="comments"><p>reader: bla bla</p></div><footer>&copy; x</footer></body></html>"""
    assert main_text(page, scores) == "Title & more\n\nFirst para with some words that are many\n\nSecond paragraph with a link in it\n\none\n\ntwo"
    assert main_text(None, scores) == main_text("", scores) == main_text("<p></p>", scores) == ""
    assert main_text("a < b && c <div", scores) == "a < b && c <div"
    assert len(Page("<div>" * 20_000 + "x").blocks) == 1 and Page('<a "' * 20_000).blocks


def test_forms_formulas_and_buttons():
    scores = Scores({"p": (10_000, 10), "h1": (500, 5)}, (600, 20))
    words = " ".join(f"w{i}" for i in range(60))
    assert main_text(f"<body><form id=aspnet><div><p>{words}</p><p>{words}</p></div></form></body>", scores) == f"{words}\n\n{words}"
    page = f"<body><article><p>{words} <math>a+b</math> so <button>holds</button></p><form><p>send me</p></form><p>{words}</p></article><button>Share</button></body>"
    assert main_text(page, scores) == f"{words} a+b so holds\n\n{words}"


def test_toxicity_of_texts_without_words():
    model = toxicity.train(pa.array(["", " ", "\n", "", "", ""], pa.large_string()), np.array([0, 1, 0, 1, 0, 1]), 0.5)
    assert np.isfinite(model.probability(pa.array(["", "some words"], pa.large_string()))).all()


def test_long_words_are_spelled_side_by_side():
    from piisift.llm import mixlm

    rng = np.random.default_rng(1)
    words = pa.array(["".join(chr(97 + x) for x in rng.integers(0, 4, n)) for n in (1, 63, 64, 65, 128, 5000)] + [""], pa.large_string())
    bits = np.zeros(len(words), dtype=np.int64)
    table = np.zeros((mixlm.SLOTS, 2), dtype=np.float32)
    mixlm.count_slots(words, np.ones(len(words)), table)
    for rows, *_ in mixlm.WordBits(words):
        np.add.at(bits, rows, 1)
    assert bits.tolist() == [8 * (len(w.as_py()) + 1) for w in words]  # all bytes and the closing one
    assert table.sum() == mixlm.ORDERS * bits.sum()
    model = mixlm.MixModel(table)
    before = mixlm.WORD_PIECE
    try:
        whole = model.cost(words)
        assert np.isfinite(whole).all() and (whole < 0).all()
        mixlm.WORD_PIECE = 1 << 20
        assert whole[:2] == pytest.approx(model.cost(words)[:2])  # up to one piece nothing differs
    finally:
        mixlm.WORD_PIECE = before


def test_extract_text_on_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    rows = pages.select("page_id", "url", "html").union(spark.createDataFrame([(-1, None, None), (-1, None, None)], "page_id long, url string, html string"))
    out = {r["page_id"]: r["text"] for r in extract_text(rows.withColumn("text", F.lit("clash"))).collect()}
    assert out[-1] == "" and len(out) == pages.count() + 1
    import html
    import re

    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inside))
        assert out[r["page_id"]] == "\n\n".join(b for b in blocks if b)
    assert extract_text(rows.limit(0)).count() == 0


def _labelled():
    rows = duckdb.sql("SELECT d.doc_id, d.text, l.toxic, l.quality FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' l USING (doc_id)").fetchall()
    held = np.array([zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows])
    return pa.array([r[1] for r in rows], pa.large_string()), held, np.array([r[2] for r in rows]), np.array([r[3] for r in rows])


def _order_rate(score, y):
    """Share of (1, 0) pairs in the right order."""
    rank = np.argsort(np.argsort(score))
    ones = int(y.sum())
    return (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def test_classifiers_on_held_out_labels():
    texts, held, toxic, good = _labelled()
    for module, y, least in ((toxicity, toxic, 0.93), (quality, good, 0.98)):
        fit = np.flatnonzero(~held)
        model = module.train(texts.take(pa.array(fit)), y[fit], float(y[fit].mean()))
        p = model.probability(texts.take(pa.array(np.flatnonzero(held))))
        assert ((p >= 0) & (p <= 1)).all() and _order_rate(p, y[held]) > least
        assert ((p >= 0.7) == y[held]).mean() > 0.93
        odd = pa.array(["", " ", "x", "word " * 30_000], pa.large_string())
        assert len(model.probability(odd)) == 4 and len(model.probability(odd.slice(0, 0))) == 0
        assert model.probability(odd).tolist() == [float(model.probability(odd.slice(i, 1))[0]) for i in range(4)]


def test_classifier_queries_on_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, None, 1), (7, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    usable = remainder(F.col("doc_id"), 3) != 5
    for model, score in ((toxicity.toxicity_model(docs, labels, usable), toxicity.score_toxicity), (quality.quality_model(docs, labels, usable), quality.score_quality)):
        rows = score(docs, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows) and score(no_docs, model).count() == 0
    model = toxicity.toxicity_model(no_docs, labels.limit(0), usable)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_lm_scores_against_counts(spark, docs, no_docs):
    big = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    df = big.union(docs.select("doc_id", "text"))
    learn = remainder(F.col("doc_id"), 10) != 0
    got = score_texts(df, learn).collect()
    assert len(got) == df.count()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    counts, tokens = {}, {}
    for d, t in rows:
        w = [*words_of(t), None]
        tokens.setdefault(d, []).append(w)
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    held_base = held_score = 0.0
    for r in got:
        bases = [sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w) for w in tokens[r["doc_id"]]]
        near = min(range(len(bases)), key=lambda i: abs(bases[i] - r["base_score"]))
        w = tokens[r["doc_id"]][near]
        assert r["base_score"] == pytest.approx(bases[near], rel=1e-9) and r["train_tokens"] == n
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(x in counts for x in w)
        assert math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0:
            held_base += r["base_score"]
            held_score += r["score"]
    # the counts give unseen words more than there is in total; with few tokens that weighs, so only nearness is asked here
    assert held_score > 1.1 * held_base
    assert score_texts(no_docs, learn).count() == 0
    assert all(math.isfinite(r["score"]) for r in score_texts(docs, F.lit(False)).collect())


def test_follow_states():
    codes = np.array([1, 2, 3, 1, 2, 3, 9, 1, 2], dtype=np.int64)
    states = follow(codes, np.array([7, 2]))
    # the 2 after the second 1 is right (state 1), the 3 after it too (state 2), the 9 wrong (state 3); texts are apart
    assert states.tolist() == [0, 0, 0, 0, 3, 5, 6, 0, 0]


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {}
    for name, stage in pipeline.STAGES[1:-1]:  # the trained stage is covered above
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in out.collect()]
        before[name] = rows
        docs = spark.createDataFrame(out.collect(), docs.schema)
    texts = [t for _, t in before["exact_dedup"]]
    assert len(texts) == len(set(texts)) and len(before["near_dedup"]) <= len(texts)
    assert {d for d, _ in before["mix"]} <= {d for d, _ in before["near_dedup"]}
    pieces = pipeline.pack(spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in pieces} == {d for d, _ in before["mix"]}


def _ordered_texts(n, seed):
    """Texts over 400 words in which one of two words follows each word: a text is too short to show it by itself."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        at, words = int(rng.integers(400)), []
        for _ in range(30):
            words.append(f"w{at}")
            at = (at * 7 + 3 + 11 * int(rng.integers(2))) % 400
        yield " ".join(words)


def test_lm_scores_use_word_order(spark):
    texts = [*_ordered_texts(1500, 1), *_ordered_texts(50, 2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = [r for r in score_texts(df, F.col("doc_id") < 1500).collect() if r["doc_id"] >= 1500]
    tokens = sum(r["n_tokens"] for r in held)
    # a word costs one bit (0.3) after its predecessor and 2.6 by itself
    assert sum(r["base_score"] for r in held) / tokens < -2.4
    assert sum(r["score"] for r in held) / tokens > -1.0


def test_lm_weights_learn_from_words_of_any_count(spark):
    words = spark.createDataFrame([(f"{a}{b}tion", 2) for a in "abcdefgh" for b in "klmnoprst"], "word string, c long")
    learnt, start = train_model(words), MixModel.__new__(MixModel)
    start.start()
    assert (learnt.weights != start.weights).any() and all((x != y).any() for x, y in zip(learnt.refined, start.refined, strict=True))
    fresh = pa.array(["zation", "eztion"])
    table = MixModel.__new__(MixModel)
    vars(table).update(vars(learnt) | {"weights": start.weights, "refined": start.refined})
    assert learnt.cost(fresh).sum() > table.cost(fresh).sum()


def test_main_text_in_wrappers_of_boilerplate_classes():
    scores = Scores({"p": (10_000, 10), "h1": (500, 5)}, (600, 20))
    body = "<h2 id=related-work>Related work</h2><p>Some words of the first paragraph <span class=share>shared</span> here<p>and of the second one, to its end"
    text = "Related work\n\nSome words of the first paragraph shared here\n\nand of the second one, to its end"
    for start, end in (
        ('<div class="content-sidebar-wrap"><main>', "</main></div>"),
        ('<div class="widget Blog">', "</div>"),
        ('<div class="post has-sidebar">', "</div>"),
        ('<section class="no-comments">', "</section>"),
        ('<div class="sidebar"><article>', "</article></div>"),
        ("<form action=x><main>", "</main></form>"),
    ):
        assert main_text(f"<body>{start}{body}{end}</body>", scores) == text
    inner = "<main><p>Some words of the first paragraph here</p><div class=related>Read this</div><form>send</form><p>and of the second one, to its end</p></main>"
    assert main_text(f"<body><form>{inner}</form></body>", scores) == "Some words of the first paragraph here\n\nand of the second one, to its end"
    assert main_text("<main hidden>Some words not shown</main><aside><article>A teaser</article></aside>", scores) == ""


def test_main_text_goes_on_after_a_long_aside():
    scores = Scores({"p": (10_000, 10), "h1": (500, 5)}, (600, 20))
    first, second = "first half of the article " * 8, "second half of the article " * 9
    links = "".join(f"<li><a href=x>more of link {i}</a>" for i in range(60))
    text = f"{first.strip()}\n\n{second.strip()}"
    for left_out in (f"<aside><ul>{links}</ul></aside>", f"<div class=ad><p>{'buy now ' * 100}</div>", f"<form>{'send it ' * 200}</form>"):
        for start, end in (("<article>", "</article>"), ("<div><div>", "</div></div>")):
            page = f"<body><p>Menu{start}<section><p>{first}</section>{left_out}<section><p>{second}</section>{end}<div><p>Imprint</div></body>"
            assert main_text(page, scores) == text
