"""Exact dedup, n-gram join, suffix dedup and top-k against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import ROWS, docs, no_docs, words_of  # noqa: F401
from pyspark.sql import functions as F

from piisift.llm import jaccard
from piisift.llm.common import stored
from piisift.llm.exact_dedup import drop_copies, exact_groups
from piisift.llm.grouping import common_prefixes, suffix_array
from piisift.llm.jaccard import Bands, ngram_hashes, one_of_each_group, signatures, similar_groups
from piisift.llm.suffix_dedup import remove_repeats
from piisift.llm.topk import top_k


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(docs, keep):
    got = exact_groups(docs, keep=keep).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    for r in ROWS:
        by_text.setdefault(r[1] or "", []).append(r[0])
    for r in got:
        ids = next(v for k, v in by_text.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == ((max if keep == "largest" else min)(known) if known else None)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(by_text) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_drop_copies_with_clashing_columns(spark):
    rows = [(1, "x", "a", 7, 8, 9), (2, "x", "b", 7, 8, 9), (3, "y", "c", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _4_sha int, __bytes int, kept__sha int")
    assert sorted(map(tuple, drop_copies(df, keep="smallest").collect())) == [rows[0], rows[2]]


def test_drop_copies_keeps_columns_and_one_row_a_text(docs, no_docs):
    out = drop_copies(docs, keep="smallest")
    assert out.columns == docs.columns
    rows = out.collect()
    texts = [r["text"] or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in ROWS})
    assert {r["doc_id"] for r in rows if r["text"] and r["text"].startswith("the quick")} == {1}
    assert drop_copies(no_docs).count() == 0 and exact_groups(no_docs).count() == 0


def brute_components(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_similar_groups_on_odd_rows(docs, no_docs):
    got = sorted((tuple(r) for r in similar_groups(docs, k=4, threshold=(85, 100)).collect()), key=str)
    assert got == brute_components([r[:2] for r in ROWS], 4, 85, 100)
    assert similar_groups(no_docs).count() == 0


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_similar_groups_on_edited_copies(spark, k, num):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 60, 300]))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[rng.randrange(0, 1 + len(w) // 10) :]
            rows.append((len(rows), " ".join(w)))
    got = sorted((tuple(r) for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=k, threshold=(num, 100)).collect()), key=str)
    assert got == brute_components(rows, k, num, 100)


def test_few_words_in_all():
    """Slices with fewer words than an n-gram, in one text or in several."""
    for k in range(1, 7):
        for total in range(2 * k + 1):
            for counts in ([total], [0, total], [total // 2, 0, total - total // 2], [1] * total):
                counts = np.array(counts, dtype=np.int64)
                words = np.arange(1, int(counts.sum()) + 1, dtype=np.uint64)
                hashes, sizes = ngram_hashes(counts, words, k)
                assert sizes.tolist() == [0 if n == 0 else max(1, n - k + 1) for n in counts.tolist()] and len(hashes) == sizes.sum()


@pytest.mark.parametrize("texts", [["a b c"], ["a b c", "A b c", None, "", "one", "x y", "x z"]])
def test_tiny_tables(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    for k in (4, 5):
        got = sorted((tuple(r) for r in similar_groups(df, k=k, threshold=(80, 100)).collect()), key=str)
        assert got == brute_components(list(enumerate(texts)), k, 80, 100)
    assert one_of_each_group(df).count() == len({(t or str(i)).lower() for i, t in enumerate(texts)})


def test_similar_sets_share_a_signature():
    rng, bands = np.random.default_rng(2), Bands(85, 100)
    for _ in range(600):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(6, 2500)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 7 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and both != max(len(a), len(b)):
            sig, per = signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
            assert set(sig[: per[0]]) & set(sig[per[0] :])


def test_unlike_texts_with_a_common_passage_bring_no_sets(spark, monkeypatch):
    rng, brought = random.Random(3), []
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"w{rng.randrange(10**9)}" for _ in range(60))])) for i in range(150)]
    rows += [(200 + i, f"{text} end{i}") for i, (_, text) in enumerate(rows[:3])]
    monkeypatch.setattr(jaccard, "stored", lambda df: brought.append(stored(df)) or brought[-1])
    got = sorted((tuple(r) for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=5, threshold=(80, 100)).collect()), key=str)
    assert got == brute_components(rows, 5, 80, 100)
    assert brought[0].count() == 6


def test_sketches_part_no_similar_sets():
    rng, bands = np.random.default_rng(4), Bands(80, 100)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, int(rng.integers(1, 700)), dtype=np.uint64)
        for _ in range(5):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.2], base[:1], rng.integers(0, 2**63, int(rng.integers(0, len(base) // 7 + 1)), dtype=np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    words, width = jaccard.sketches(np.concatenate(sets), sizes)
    bits = np.split(words, np.cumsum(width)[:-1])
    for side in (np.zeros(len(sets), dtype=int), np.arange(len(sets)) % 2):
        root = list(range(len(sets)))
        for u, v in jaccard.alike_within(np.arange(len(sets)), sizes, bits, side, np.zeros(len(sets), dtype=bool), bands):
            root = [root[u] if r == root[v] else r for r in root]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both) and (side[i] != side[j] or not side.any()):
                    assert root[i] == root[j]
        assert len(set(root)) >= 40


def test_dealt_signatures_meet(monkeypatch):
    """Whatever is gathered and however many parts there are, classes of one signature in a band come together."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(40))) for _ in range(150)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    by_signature = {}
    for _, hashes, sizes, cls in jaccard._documents(batch, 2):
        for s, d, band in zip(*(x.tolist() for x in jaccard.banded_signatures(hashes, sizes, Bands(80, 100))), strict=True):
            by_signature.setdefault(s, set()).add(int(cls[d]) ^ band)
    for gathered, parts in ((1, 7), (1 << 20, 1), (500, 40)):
        monkeypatch.setattr(jaccard, "GATHERED", gathered)
        rows = sorted((r for b in jaccard._dealt_signatures(2, 80, 100, parts)(iter([batch])) for r in b.to_pylist()), key=lambda r: r["part"])
        pairs = [p for b in jaccard._meetings(pa.RecordBatch.from_pylist(rows[i : i + 9]) for i in range(0, len(rows), 9)) for p in b.to_pylist()]
        together = {}
        for p in pairs:
            together.setdefault(p["u"], set()).add(p["v"])
        for nodes in by_signature.values():
            assert all(min(nodes) in together[n] for n in nodes if n != min(nodes))


def test_one_of_each_group(docs):
    out = one_of_each_group(docs, k=5, threshold=(80, 100))
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 1 in ids and 2 not in ids and {4, 5, 6, 9, 10} <= set(ids) and ids.count(None) == 2
    assert (7 in ids) and (8 not in ids)  # equal after lower-casing


def test_suffix_array_by_grouping():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 30))] + [0]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix_array(s) == order
        shared = common_prefixes(s, order)
        for a, b in zip(order, order[1:], strict=False):
            n = shared[b]
            assert s[a : a + n] == s[b : b + n] and s[a + n] != s[b + n]


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        mask = np.zeros(len(d), dtype=bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                mask[p : p + length] = True
        out.append((len(d), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), np.frombuffer(d, np.uint8)[~mask].tobytes()))
    return out


@pytest.mark.parametrize("part,size", [(4096, 1 << 20), (3, 1 << 20), (4096, 150), (3, 500)])
def test_remove_repeats(spark, monkeypatch, part, size):
    """Also with suffix arrays of few runs, and with texts read a few windows at a time."""
    import piisift.llm.suffix_dedup as module

    monkeypatch.setattr(module, "PART", part)
    monkeypatch.setattr(module, "SLICE", size)
    rng = random.Random(3)
    letters = "abcdeé "
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (60, 80, 150, 400)]
    texts = [None, "", "short", "x" * 300, "ab" * 120, passages[3], passages[3], "".join(rng.choice(letters) for _ in range(900)) + passages[2] + "".join(rng.choice(letters) for _ in range(700)) + passages[2]]
    for _ in range(60):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 200)))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
            t += p[a:b] + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))
        texts.append(t)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(4, texts[4], 2), (None, texts[-1][:50], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in remove_repeats(df, length=48).collect()), key=str)
    want = sorted(((r[0], *w) for r, w in zip(rows, brute_repeats([r[1] for r in rows], 48), strict=True)), key=str)
    assert got == want
    assert remove_repeats(df.limit(0), length=48).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist(), "x") for i in range(130)]
    rows += [(7, rows[7][1], "x"), (200, None, "x"), (210, [1.0, None, 0.0, 0.0, 0.0], "x"), (220, [float("nan")] * 5, "x"), (230, [float("inf")] * 5, "x"), (240, [1.0, 2.0], "x"), (None, [1.0] * 5, "x"), (250, [], "x"), (251, [], "x")]
    rows += [(300 + i, [0.5] * 5, "x") for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    got = {}
    for r in top_k(df, F.col("vec_id") % 10 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, v in {i: v for i, v in good if i % 10 == 0}.items():
        other = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:10]
        assert got.pop(q, []) == [(n, i, -s) for n, (s, i) in enumerate(other, 1)]
    assert not got
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
