"""Periodic runs, clusters on bit planes and fingerprints against brute force."""

import hashlib
import random

import numpy as np
import pytest
from odd_rows import ROWS, docs, no_docs, words_of  # noqa: F401
from pyspark.sql import functions as F

from piisift.llm import periodic
from piisift.llm.bitplanes import LARGEST, cluster_vectors, component_sums, nearest, pack, products
from piisift.llm.winnowing import as_text, fingerprint, fingerprint_edits, likeness


def brute_runs(words, minimum, repeats):
    found = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(minimum, repeats * q) and not any(p < q and s <= i and i + size <= s + n for s, n, p in found):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("minimum,repeats", [(24, 3), (6, 3), (4, 2), (9, 4), (2, 2)])
def test_runs_of_random_words(spark, minimum, repeats, monkeypatch):
    monkeypatch.setattr(periodic, "TREE_WORDS", 64)
    rng, texts = random.Random(minimum), []
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 7)):
            unit = [rng.choice("abcdé") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 9))]
            words += (unit * 12)[: rng.randrange(1, 60)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    out = periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), minimum=minimum, repeats=repeats).collect()
    assert len(out) == len(rows)
    for r in out:
        words = texts[r["doc_id"]].split()
        runs = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
        assert runs == brute_runs(words, minimum, repeats)
        assert r["n_words"] == len(words) and r["collapsed"] == brute_collapsed(words, runs)


def test_runs_of_odd_rows(docs, no_docs):
    rows = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(docs).collect()), key=str)
    want = []
    for r in ROWS:
        words = words_of(r[1], lower=False)
        runs = brute_runs(words, 24, 3) if len(words) < 100 else [(0, 3000, 1)]
        want.append((r[0], len(words), runs, brute_collapsed(words, runs)))
    assert rows == sorted(want, key=str)
    assert periodic.find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, repeats=1)


def test_long_runs_and_extensions():
    rng = random.Random(7)
    unit = [rng.randrange(50) for _ in range(2000)]
    words = [rng.randrange(50) for _ in range(500)] + unit * 4 + [51, 52] + [7] * 4000
    _, start, length, period = periodic.runs_in([np.array(words)], 24, 3)
    assert (8502, 4000, 1) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) and 2000 in period.tolist()
    text = [rng.randrange(3) for _ in range(400)] + [9]
    reach = periodic.SuffixTree(text).extensions()
    i, j = np.array([rng.sample(range(401), 2) for _ in range(2000)]).T
    for a, b, n in zip(i.tolist(), j.tolist(), reach.of(i, j).tolist(), strict=True):
        k = 0
        while max(a, b) + k < 401 and text[a + k] == text[b + k]:
            k += 1
        assert n == k


def test_periodic_tail_of_the_query(spark):
    import zlib

    from piisift.llm.queries import _with_periodic_tail

    rows = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)] + [(None, "a b"), (5, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", _with_periodic_tail(F.col("text"), F.col("doc_id")).alias("x")).collect()
    changed = 0
    for r in got:
        words = (r["text"] or "").split()
        h = zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert (r["x"] or "").split() == words
    assert changed > 10


def test_planes():
    rng = np.random.default_rng(3)
    for top in (1, 2, 70, 1 << 20, LARGEST):
        a, b = rng.integers(-top, top, (50, 64)), rng.integers(-top, top, (50, 64))
        a[0], b[1] = -top, top - 1
        assert (products(pack(a), pack(b)) == (a * b).sum(axis=1)).all()
        assert (component_sums(pack(a)) == a.sum(axis=0)).all()
        at, distance = nearest(pack(a), b[:7])
        full = ((a[:, None, :] - b[None, :7, :]) ** 2).sum(axis=2)
        assert (at == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def brute_clusters(rows, k, rounds, scale, dim):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and None not in v and np.isfinite(np.array(v, dtype=float)).all():
            kept.append((i, [max(-LARGEST, min(LARGEST - 1, int(np.floor(scale * float(np.float32(x)))))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (_, n) in zip(kept, at, strict=True) if n == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, assign(), strict=True)), key=str), centroids


@pytest.mark.parametrize("k", [1, 3, 16, 200])
def test_clusters(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, (rng.normal(size=6) + 3 * (i % 4)).astype(np.float32).tolist()) for i in range(90)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (200, None), (201, [1.0] * 5), (202, [None] + [1.0] * 5), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, []), (206, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string").repartition(4)
    found, clusters = cluster_vectors(df, k=k, rounds=3, scale=64, dim=6)
    want, centroids = brute_clusters(rows, k, 3, 64, 6)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    by = {r["cluster"]: r for r in clusters.collect()}
    assert [by[c]["centroid"] for c in range(len(centroids))] == centroids
    for c, r in by.items():
        assert r["cluster_inertia"] == sum(d for _, n, d in want if n == c) and r["inertia"] == sum(d for _, _, d in want)


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, clusters = cluster_vectors(none)
    assert found.count() == clusters.count() == 0
    found, clusters = cluster_vectors(spark.createDataFrame([(1, [0.5] * 64)] * 3, "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0)] * 3 and clusters.count() == 3


def brute_prints(text, k, window):
    hashes = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words_of(text, lower=False)]

    def turned(x, bits):
        bits %= 64
        return (x << bits | x >> (64 - bits)) & (1 << 64) - 1 if bits else x

    def gram(part):
        out = 0
        for h in part:
            out = turned(out, 1) ^ h
        return out

    grams = [gram(hashes[i : i + k]) for i in range(max(len(hashes) - k + 1, min(1, len(hashes))))]
    keys = [(g >> 20 & (1 << 31) - 1, -i) for i, g in enumerate(grams)]
    chosen = sorted({-min(keys[i : i + window])[1] for i in range(max(len(keys) - window + 1, min(1, len(keys))))})
    return [(grams[i], i) for i in chosen]


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("k,window", [(5, 8), (1, 1), (3, 5), (6, 12), (8, 3), (70, 4)])
def test_fingerprints(spark, docs, k, window):
    rng = random.Random(k)
    texts = [r[1] for r in ROWS] + [" ".join(rng.choice(["ab", "cd", "é", "x"]) for _ in range(n)) for n in (*range(0, 20), 150, 700)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(3)
    out = {r["i"]: r for r in df.select("i", fingerprint(F.col("t"), k, window).alias("p")).select("i", "p", as_text(F.col("p")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = brute_prints(t, k, window)
        assert [(p["hash"] % (1 << 64), p["position"]) for p in out[i]["p"]] == want
        assert out[i]["s"] == " ".join(f"{h:X}@{p}" for h, p in want)


def test_shared_passages_are_found(spark):
    rng, rows = random.Random(1), []
    for i in range(60):
        a, b, shared = ([f"{c}{rng.randrange(500)}" for _ in range(n)] for c, n in (("a", 40), ("b", 30), ("c", 12 if i % 2 else 4)))
        rows.append((i, " ".join([*a, *shared, *a[:9]]), " ".join([*b, *shared, *b[:5]])))
    df = spark.createDataFrame(rows, "i long, x string, y string")
    found = df.select("i", fingerprint(F.col("x")).alias("p"), fingerprint(F.col("y")).alias("q")).select("i", likeness(F.col("p"), F.col("q")).alias("n")).collect()
    assert all((r["n"] > 0) == bool(r["i"] % 2) for r in found)  # 12 words = window + k - 1; 4 words are fewer than k


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_fingerprints_of_edits(spark, docs, no_docs, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(2)
        big = [(rng.choice([i, i * 10**9]), " ".join(rng.choice(["ab", "cd", "efé", "x"]) for _ in range(rng.randrange(60)))) for i in range(200)]
        for rows, df in ((ROWS, docs), (big, spark.createDataFrame(big, "doc_id long, text string").repartition(5)), (big[:1], spark.createDataFrame(big[:1], "doc_id long, text string"))):
            got = sorted(((r["doc_id"], r["text"], r["edited"], r["near_edited"], r["near_next"]) for r in fingerprint_edits(df).collect()), key=str)
            ids = [(r[0], r[1] or "") for r in rows]
            assert [g[:2] for g in got] == sorted(ids, key=str)
            free = [r for r in ids if sum(x[0] == r[0] for x in ids) == 1 and r[0] is not None]
            follows = sorted({r[0] for r in ids if r[0] is not None})
            for doc_id, text in free:
                at = follows.index(doc_id)
                last = at + 1 == len(follows)
                after = {t for d, t in ids if d == (follows[at + 1] if not last else None)} if not last or any(d is None for d, _ in ids) else {t for d, t in ids if d == follows[0]}
                n = len(text) // 4
                (mine,) = [g for g in got if g[0] == doc_id]
                fits = [t for t in after if mine[2] == text[: len(text) - n] + t[:n] and mine[4] == alike(brute_prints(text, 5, 8), brute_prints(t, 5, 8))]
                assert fits and mine[3] == alike(brute_prints(text, 5, 8), brute_prints(mine[2], 5, 8))
        assert fingerprint_edits(no_docs).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
