"""Removal of byte strings that occur elsewhere, decided by suffix arrays built by linear grouping.

A byte goes when a string of ``length`` bytes that covers it also starts at any
other place of the corpus.  One suffix array over a corpus has no place on a
cluster, so windows (strings of that length) first meet by content:

1. Each window's anchor is its k-gram of least hash among its first ``ANCHORS``
   positions, so equal windows have equal anchors at the same place.  Windows
   that share an anchor form a run; what lies in all of them (the anchor's
   kernel) names the group in which they can have equals.
2. Runs that are equal as a whole need no more: all their windows have equals.
3. Of the other runs in a group, one of each kind brings the bytes before and
   behind the kernel.  The bytes are cut where any two of the group diverge;
   each piece becomes a symbol, the kernel another, and the suffix array of
   these strings (grouping construction) with its common prefixes tells for
   each window whether any other run continues equally up to its end.

Texts that occur as a whole more than once go entirely and travel once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piisift.llm.common import BASE, byte_values, cut, give_back, mix64, spans_of, text_array, text_slices
from piisift.llm.grouping import common_prefixes, suffix_array

#: Bytes of an anchor; bytes of text hashed at once (of a longer text: windows at once); runs in one suffix array (larger groups are cut into parts); runs gathered per array.
GRAM, SLICE, PART, GATHER = 24, 1 << 20, 4096, 8192
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


class Hasher:
    """Hashes of any range of a byte string, from running sums modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self.values = byte_values()

    def load(self, data: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            if len(self.up) <= len(data):
                self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(data), BASE, dtype=np.uint64))])
                self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(data), BACK, dtype=np.uint64))])
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(self.values[data] * self.up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def runs_of(hasher: Hasher, data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor) of all runs; positions count from the start of ``data``."""
    reach = length // 2  # an anchor lies in the first half of its windows
    starts, stops = ends[:-1], ends[1:]
    long = np.flatnonzero(stops - starts >= length)
    if not len(long):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    grams = hasher.grams(GRAM)
    bits = np.uint64(max(1, len(data).bit_length()))
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal hashes is least
    grid = np.concatenate([keys, np.full(-len(keys) % reach, np.iinfo(np.uint64).max)]).reshape(-1, reach)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()[: len(keys)]
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[: len(keys)]
    least = np.minimum(behind[: len(keys) - reach + 1], ahead[reach - 1 :])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    turn = np.zeros(len(anchor) + 1, dtype=np.int32)
    np.add.at(turn, starts[long], 1)
    np.add.at(turn, np.minimum(stops[long] - length + 1, len(anchor)), -1)
    window = np.cumsum(turn[:-1]) > 0
    first = window.copy()
    first[1:] &= ~window[:-1] | (anchor[1:] != anchor[:-1])
    first[starts[long]] = True
    last = window.copy()
    last[:-1] &= ~window[1:] | first[1:]
    p0, p1 = np.flatnonzero(first), np.flatnonzero(last)
    return np.searchsorted(ends, p0, side="right") - 1, p0, p1, anchor[p0]


def _runs(length: int):
    """(cls, check, text) -> one row per text that has windows: its runs, texts that the task has seen left out."""
    reach = length // 2
    names = ["cls", "check", "k", "d", "p0", "p1", "a"]

    def runs(part: pa.RecordBatch, hasher: Hasher, data: np.ndarray, ends: np.ndarray, first: int) -> pa.RecordBatch:
        hasher.load(data)
        text, p0, p1, a = runs_of(hasher, data, ends, length)
        kernel = hasher.ranges(a, a + (length - reach + 1))
        whole = hasher.ranges(p0, p1 + length) + mix64(((a - p0) * length + (a - p1)).astype(np.uint64))
        use, begin = np.unique(text, return_index=True)
        offsets = pa.array(np.append(begin, len(text)), pa.int32())
        base = ends[:-1][text] - first
        columns = [part.column(0).take(pa.array(use)), part.column(1).take(pa.array(use))]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64), pa.int64())) for x in (kernel, whole)]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(x - base, pa.int32())) for x in (p0, p1, a)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                ids = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                fresh = []
                for i, key in enumerate(ids):
                    if key not in seen:
                        seen.add(key)
                        fresh.append(i)
                part = part.take(pa.array(fresh, pa.int64()))
                data, ends = spans_of(text_array(part).cast(pa.large_binary()))
                if part.num_rows > 1 or len(data) < SLICE + length:
                    if len(data) >= length:
                        yield runs(part, hasher, data, ends, 0)
                    continue
                # a long text, ``SLICE`` windows at a time; a run that goes on in the next part is two runs, whose windows lie apart
                for at in range(0, len(data) - length + 1, SLICE):
                    piece = data[at : at + SLICE + length - 1]
                    yield runs(part, hasher, piece, np.array([0, len(piece)]), at)
        del hasher, seen
        give_back()

    return task


def _contexts(length: int):
    """(cls, check, text, wanted runs) -> each wanted run with the bytes before its anchor (nearest first) and behind its kernel."""
    kernel = length - length // 2 + 1
    names = ["k", "part", "parts", "cls", "check", "p0", "p1", "a", "shared", "left", "right"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cls, check, text, wanted = (c[i].as_py() for c in batch.columns)
                data = (text or "").encode()
                rows = []
                for w in wanted:
                    p0, p1, a = w["p0"], w["p1"], w["a"]
                    rows.append((w["k"], w["part"], w["parts"], cls, check, p0, p1, a, w["shared"], data[p0:a][::-1], data[a + kernel : p1 + length]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        give_back()

    return task


def _branches(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places where any two strings diverge, with 0; class of each string by its bytes up to the end of each piece; pieces to use).

    A string is of use up to the first piece that no other shares.
    """
    size = max(map(len, strings))
    order = sorted(range(len(strings)), key=strings.__getitem__)
    shared = np.empty(len(strings) - 1, dtype=np.int64)
    for i, (x, y) in enumerate(zip(order, order[1:], strict=False)):
        a, b = strings[x], strings[y]
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            n = int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))
        shared[i] = n
    begin = np.unique(np.append(shared[shared < size], 0))
    end = np.append(begin[1:], size)
    classes = np.zeros((len(end), len(strings)), dtype=np.int64)
    classes[:, order[1:]] = np.cumsum(shared[None, :] < end[:, None], axis=1)
    # in the order, a string is alone if it diverges from both neighbours before the piece ends
    apart = np.ones((len(end), len(strings) + 1), dtype=bool)
    apart[:, 1:-1] = shared[None, :] < end[:, None]
    alone = np.zeros((len(end) + 1, len(strings)), dtype=bool)
    alone[:-1, order] = apart[:, 1:] & apart[:, :-1]
    alone[-1] = True
    own = np.searchsorted(begin, [len(x) for x in strings], side="left")
    return begin, classes, np.minimum(own, alone.argmax(axis=0) + 1)


def repeated_windows(groups: list[list[tuple]], length: int) -> list[list[np.ndarray]]:
    """For each run of each group the windows (distance before the anchor, ascending) that another run of its group holds too.

    A run is ``(first window, last window, anchor, left bytes, right bytes)``.
    """
    behind = length - (length - length // 2 + 1)  # bytes behind the kernel of the window that starts at the anchor
    text: list[int] = []
    kernels, cuts, symbol, mark = [], [], 1, -1
    for runs in groups:
        lefts, left_class, left_use = _branches([r[3] for r in runs])
        rights, right_class, right_use = _branches([r[4] for r in runs])
        n = len(runs)
        left_symbol = (left_class + (np.arange(len(lefts)) * n)[:, None] + symbol + 1).T.tolist()
        right_symbol = (right_class + ((np.arange(len(rights)) + len(lefts)) * n)[:, None] + symbol + 1).T.tolist()
        for ls, rs, i, k in zip(left_symbol, right_symbol, left_use.tolist(), right_use.tolist(), strict=True):
            text += ls[:i][::-1]
            kernels.append(len(text))
            text.append(symbol)
            text += rs[:k]
            text.append(mark)
            mark -= 1
        cuts.append((lefts, rights, left_use))
        symbol += 1 + (len(lefts) + len(rights)) * n
    order = suffix_array(text)
    prefix = np.array(common_prefixes(text, order), dtype=np.int64)
    order_ = np.array(order)
    reach = prefix.copy()
    reach[order_[:-1]] = np.maximum(reach[order_[:-1]], prefix[order_[1:]])
    out, at = [], iter(kernels)
    for runs, (lefts, rights, left_use) in zip(groups, cuts, strict=True):
        found = []
        for (p0, p1, a, _, _), use in zip(runs, left_use.tolist(), strict=True):
            j = np.arange(a - p1, a - p0 + 1)
            before = np.searchsorted(lefts, j, side="left")
            after = np.searchsorted(rights, behind - j, side="left")
            equal = reach[next(at) - np.minimum(before, use)] >= before + 1 + after
            found.append(j[equal & (before <= use)])
        out.append(found)
    return out


def _decide(length: int):
    """Runs sorted by (k, part) -> spans of repeated windows, and for groups in several parts every window by its hash."""
    names = ["cls", "check", "s", "e", "h", "open"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]

    def decided(held: list[list[dict]]) -> pa.RecordBatch:
        rows = []
        groups = [[(r["p0"], r["p1"], r["a"], r["left"], r["right"]) for r in g] for g in held]
        for g, found in zip(held, repeated_windows(groups, length) if groups else [], strict=True):
            for r, j in zip(g, found, strict=True):
                a = r["a"]
                if not r["shared"] and len(j):
                    gap = np.flatnonzero(np.diff(j) > 1)
                    for low, high in zip(j[np.append(0, gap + 1)].tolist(), j[np.append(gap, len(j) - 1)].tolist(), strict=True):
                        rows.append((r["cls"], r["check"], a - high, a - low + length, None, None))
                if r["parts"] > 1:
                    known = set(j.tolist())
                    for d in range(a - r["p1"], a - r["p0"] + 1):
                        window = r["left"][:d] + b"|" + r["right"][: length - (length - length // 2 + 1) - d]
                        digest = hashlib.blake2b(window, digest_size=8, key=str((r["k"], d)).encode()).digest()
                        rows.append((r["cls"], r["check"], a - d, a - d + length, int.from_bytes(digest, "little", signed=True), d not in known and not r["shared"]))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if (row["k"], row["part"]) != key:
                    if size >= GATHER:
                        yield decided([g for g in held if len(g) > 1 or g[0]["parts"] > 1])
                        held, size = [], 0
                    key = (row["k"], row["part"])
                    held.append([])
                held[-1].append(row)
                size += 1
        yield decided([g for g in held if len(g) > 1 or g[0]["parts"] > 1])
        del held
        give_back()

    return task


def _removed(length: int):
    """(doc_id, text, copies, spans) -> doc_id, n_bytes, merged spans, the bytes kept."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sizes, spans, kept = [], [], []
                for text, copies, found in zip(*[part.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                    data = (text or "").encode()
                    merged: list[list[int]] = []
                    if copies > 1 and len(data) >= length:
                        merged = [[0, len(data)]]
                    elif found:
                        for s, e in sorted((x["s"], x["e"]) for x in found):
                            if merged and s <= merged[-1][1]:
                                merged[-1][1] = max(merged[-1][1], e)
                            else:
                                merged.append([s, e])
                    sizes.append(len(data))
                    spans.append([{"s": s, "e": e} for s, e in merged])
                    edges = [0, *[x for m in merged for x in m], len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
        give_back()

    return task


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans`` (removed runs, start and end byte) and ``kept`` (the other bytes).

    Texts are UTF-8 bytes; null is empty.  Matches never cross documents;
    repeats within a document count; overlaps count; all strings are judged on
    the input.  A repeated row is a copy of the other.  Null ids pass through.
    A very long text is read ``SLICE`` windows at a time.  Extra columns are not
    read; an empty table gives an empty result.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("cls"), F.xxhash64(F.lit(1), body).alias("check"))
    thin = cut(source.select("doc_id", "cls", "check"))
    arrays = "k array<long>, d array<long>, p0 array<int>, p1 array<int>, a array<int>"
    runs = cut(source.select("cls", "check", "text").mapInArrow(_runs(length), f"cls long, check long, {arrays}"))
    runs = runs.select("cls", "check", F.inline(F.arrays_zip("k", "d", "p0", "p1", "a"))).withColumn("o", F.xxhash64("cls", "check", "p0"))

    # groups that hold two different places; a text that several tasks brought counts once
    groups = runs.groupBy("k", (F.col("k") + F.lit(1)).alias("_k1")).agg(F.min("o").alias("o1"), F.max("o").alias("o2")).where("o1 <> o2").select(F.col("k").alias("gk"))
    met = cut(runs.join(groups, F.col("k") == F.col("gk")).drop("gk"))
    kinds = met.groupBy("k", "d").agg((F.min("o") != F.max("o")).alias("shared"), F.min(F.struct("o", "cls", "check", "p0", "p1", "a")).alias("r"))
    kinds = cut(kinds)
    same = kinds.where("shared").select(F.col("k").alias("sk"), F.col("d").alias("sd"))
    equal = met.join(same, (F.col("k") == F.col("sk")) & (F.col("d") == F.col("sd"))).select("cls", "check", F.col("p0").alias("s"), (F.col("p1") + length).alias("e"))

    # groups with runs of several kinds, some of them single: one run of each kind brings its bytes
    mixed = kinds.groupBy("k", (F.col("k") + F.lit(1)).alias("_k1")).agg(F.count("*").alias("n"), F.count(F.when(~F.col("shared"), 1)).alias("single")).where("n > 1 and single > 0")
    mixed = mixed.select(F.col("k").alias("gk"), F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    wanted = kinds.join(mixed, F.col("k") == F.col("gk")).withColumn("part", F.pmod("d", "parts").cast("int"))
    wanted = wanted.groupBy(F.col("r.cls").alias("wc"), F.col("r.check").alias("wk")).agg(F.collect_list(F.struct("k", "part", "parts", "r.p0", "r.p1", "r.a", "shared")).alias("wanted"))
    holder = thin.groupBy("cls", "check").agg(F.min(F.struct("doc_id")).alias("h"))
    wanted = wanted.join(holder, (F.col("wc") == F.col("cls")) & (F.col("wk") == F.col("check"))).select("wc", "wk", "wanted", F.col("h.doc_id").alias("wi"))
    texts = source.join(wanted, (F.col("cls") == F.col("wc")) & (F.col("check") == F.col("wk")) & F.col("doc_id").eqNullSafe(F.col("wi")))
    schema = "k long, part int, parts int, cls long, check long, p0 int, p1 int, a int, shared boolean, left binary, right binary"
    contexts = texts.select("cls", "check", "text", "wanted").mapInArrow(_contexts(length), schema)
    contexts = contexts.repartition(partitions, "k", "part").sortWithinPartitions("k", "part", "cls", "check", "p0")
    decided = cut(contexts.mapInArrow(_decide(length), "cls long, check long, s int, e int, h long, open boolean"))

    # windows of groups in several parts meet by their hash
    across = decided.where("h is not null")
    place = F.xxhash64("cls", "check", "s")
    again = across.groupBy("h", (F.col("h") + F.lit(1)).alias("_h1")).agg(F.min(place).alias("o1"), F.max(place).alias("o2")).where("o1 <> o2").select(F.col("h").alias("hh"))
    crossing = across.where("open").join(again, F.col("h") == F.col("hh")).select("cls", "check", "s", "e")

    spans = equal.union(decided.where("h is null").select("cls", "check", "s", "e")).union(crossing)
    spans = spans.groupBy("cls", "check").agg(F.collect_set(F.struct("s", "e")).alias("spans")).select(F.col("cls").alias("sc"), F.col("check").alias("sk"), "spans")
    classes = thin.groupBy("cls", "check").agg(F.count("*").alias("copies")).join(spans, (F.col("cls") == F.col("sc")) & (F.col("check") == F.col("sk")), "left")
    classes = classes.groupBy("cls", "check", "copies").agg(F.first("spans").alias("spans")).select(F.col("cls").alias("cc"), F.col("check").alias("ck"), "copies", "spans")
    told = thin.distinct().join(classes, (F.col("cls") == F.col("cc")) & (F.col("check") == F.col("ck")))
    told = told.select(F.col("doc_id").alias("ti"), "cc", "ck", "copies", F.when(F.col("copies") == 1, F.col("spans")).alias("spans"))
    joined = source.join(told, (F.col("cls") == F.col("cc")) & (F.col("check") == F.col("ck")) & F.col("doc_id").eqNullSafe(F.col("ti")))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "copies", "spans").mapInArrow(_removed(length), f"doc_id {id_type}, n_bytes long, spans array<struct<s:int,e:int>>, kept binary")
