"""The merge fold against a model built from the merge's properties, and the islands form."""

from functools import reduce

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from piisift.functions.matches import MATCH_TYPE, merge_matches
from piisift.operators.longform import merge_long


def model_merge(matches):
    """The merge by its properties: matches in order of (start, end, emission); a result is
    disjoint and sorted, so a match can only meet the last one taken.  It follows it if they
    are apart, takes its place if strictly more confident, and goes otherwise."""

    def take(taken, i):
        start, _, confidence = matches[i]
        if not taken or start >= matches[taken[-1]][1]:
            return [*taken, i]
        return [*taken[:-1], i] if confidence > matches[taken[-1]][2] else taken

    return reduce(take, sorted(range(len(matches)), key=lambda i: (matches[i][0], matches[i][1], i)), [])


span = st.tuples(st.integers(0, 40), st.integers(1, 12), st.sampled_from([0.5, 0.6, 0.8, 0.85, 0.9, 0.95, 0.98]))
lists = st.lists(span, min_size=0, max_size=12)


@settings(max_examples=10, deadline=None)
@given(st.lists(lists, min_size=1, max_size=20))
def test_fold_equals_model_and_islands(spark, docs):
    rows = []
    for d, ms in enumerate(docs):
        for i, (s, length, conf) in enumerate(ms):
            rows.append((d, s, s + length, i, "T", f"v{i}", conf, "regex"))
    if not rows:
        return
    long = spark.createDataFrame(rows, "doc long, span_start int, span_end int, ord int, ptype string, value string, confidence double, source string")
    arr = long.groupBy("doc").agg(F.collect_list(F.struct(*[f.name for f in MATCH_TYPE.fields])).alias("ms"))
    fold = {r.doc: [m.ord for m in r.merged] for r in arr.select("doc", merge_matches(F.col("ms")).alias("merged")).collect()}
    islands = {}
    for r in merge_long(long, ["doc"]).orderBy("doc", "span_start").collect():
        islands.setdefault(r.doc, []).append(r.ord)
    for d, ms in enumerate(docs):
        if not ms:
            continue
        expected = model_merge([(s, s + n, c) for s, n, c in ms])
        assert fold[d] == expected
        assert islands.get(d, []) == expected


def test_worked_cases():
    # ADDRESS (0.8) evicted by PHONE (0.9); equal confidence keeps the first.
    assert model_merge([(0, 17, 0.8), (4, 17, 0.9)]) == [1]
    assert model_merge([(0, 5, 0.9), (0, 5, 0.9)]) == [0]


def test_long_lists_use_islands_and_match_model(spark):
    import random

    rnd = random.Random(11)
    docs = []
    for d in range(12):
        n = rnd.choice([33, 64, 200, 700])
        ms = []
        for i in range(n):
            s = rnd.randint(0, n * 3)
            ms.append((s, s + rnd.randint(1, 15), rnd.choice([0.5, 0.6, 0.8, 0.85, 0.9, 0.95, 0.98])))
        if d == 0:  # one giant island: a long span covering everything
            ms.append((0, n * 3 + 20, 0.8))
        docs.append(ms)
    rows = [(d, s, e, i, "T", f"v{i}", c, "regex") for d, ms in enumerate(docs) for i, (s, e, c) in enumerate(ms)]
    long = spark.createDataFrame(rows, "doc long, span_start int, span_end int, ord int, ptype string, value string, confidence double, source string")
    arr = long.groupBy("doc").agg(F.collect_list(F.struct(*[f.name for f in MATCH_TYPE.fields])).alias("ms"))
    got = {r.doc: [m.ord for m in r.merged] for r in arr.select("doc", merge_matches(F.col("ms")).alias("merged")).collect()}
    for d, ms in enumerate(docs):
        assert got[d] == model_merge(ms), d


def test_rows_of_one_text_over_many_parts_match_model(spark):
    """Parts of a few positions: islands that cross one or many borders, and spans longer than a part."""
    import random

    rnd = random.Random(5)
    docs = []
    for d in range(30):
        n, wide = rnd.choice([5, 60, 300]), rnd.choice([3, 12, 80])
        ms = [(s, s + rnd.randint(1, wide), rnd.choice([0.5, 0.6, 0.8, 0.9, 0.95])) for s in (rnd.randint(0, n * rnd.choice([2, 6])) for _ in range(n))]
        docs.append(ms)
    rows = [(d if d else None, s, e, i, "T", "v", c, "regex") for d, ms in enumerate(docs) for i, (s, e, c) in enumerate(ms)]
    long = spark.createDataFrame(rows, "doc long, span_start int, span_end int, ord int, ptype string, value string, confidence double, source string").repartition(4)
    for chars in (1, 7, 50):
        got = {}
        for r in merge_long(long, ["doc"], part_chars=chars).orderBy("doc", "span_start").collect():
            got.setdefault(r.doc or 0, []).append(r.ord)
        assert got == {d: model_merge(ms) for d, ms in enumerate(docs)}
    assert merge_long(long.limit(0), ["doc"]).count() == 0
