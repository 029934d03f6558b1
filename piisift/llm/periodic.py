"""Periodic runs of words, found by longest common extensions on suffix trees.

A run is a maximal stretch of words with smallest period q that holds at least
three periods.  Every run has a Lyndon root: the longest Lyndon word at its
place under the order of the symbols or under the reversed order.  So each
position gives two candidates (place, period), and each is extended both ways
by longest common extensions: Ukkonen's suffix trees of the words and of their
reversal, with the lowest common ancestor of two leaves read from the Euler
tour in constant time.

Trees are built only where a run can be.  A run of L words, r periods of q at
least, has L - 2q >= L * (r - 2) / r, so each of its grams of one word more
than ``minimum * (r - 2) / r`` occurs again one period before or after, and
the run lies in a stretch of grams that recur within that stretch.
Stretches are split at other grams until nothing changes; what is left of
several texts goes into one pair of trees, with a separator of its own behind
each stretch, so that nothing extends from one into another.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piisift.llm.common import give_back, mix64, split_words, text_array, text_slices

#: Text bytes handled at once; words of several stretches in one pair of trees (a longer stretch has a pair of its own).
SLICE, TREE_WORDS, BLOCK = 2 << 20, 1 << 16, 32


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers whose last one occurs once."""

    def __init__(self, symbols: list[int]) -> None:
        n, base = len(symbols), max(symbols) + 1
        begin, stop, link, parent, depth, suffix = (array("q", [x]) for x in (0, 0, 0, 0, 0, -1))
        child: dict[int, int] = {}
        node = edge = length = remaining = 0
        for i, c in enumerate(symbols):
            last, remaining = 0, remaining + 1
            while remaining:
                if not length:
                    edge = i
                key = node * base + symbols[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    above = node
                else:
                    span = (stop[below] if stop[below] <= i else i + 1) - begin[below]
                    if length >= span:  # walk down
                        edge, length, node = edge + span, length - span, below
                        continue
                    if symbols[begin[below] + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    above = len(begin)  # split the edge
                    child[key] = above
                    for column, x in zip((begin, stop, link, parent, depth, suffix), (begin[below], begin[below] + length, 0, node, depth[node] + length, -1), strict=True):
                        column.append(x)
                    begin[below] += length
                    parent[below] = above
                    child[above * base + symbols[begin[below]]] = below
                    child[above * base + c] = len(begin)
                if last:
                    link[last] = above
                last = above if above != node else 0
                first = i - remaining + 1
                begin.append(i), stop.append(n), link.append(0), parent.append(above), depth.append(n - first), suffix.append(first)
                remaining -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, first + 1
        self.n, self.symbols = n, np.array(symbols, dtype=np.int64)
        self.begin, self.parent, self.depth, self.suffix = (np.frombuffer(x, dtype=np.int64) for x in (begin, parent, depth, suffix))

    def children(self, symbol_order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(children of all nodes side by side, where each node's begin), by the given order of first symbols."""
        nodes = np.arange(1, len(self.parent))
        order = nodes[np.lexsort((symbol_order[self.symbols[self.begin[nodes]]], self.parent[nodes]))]
        return order, np.searchsorted(self.parent[order], np.arange(len(self.parent) + 1))

    def ranks(self, symbol_order: np.ndarray) -> np.ndarray:
        """Rank of each suffix when symbols compare by ``symbol_order``."""
        order, starts = self.children(symbol_order)
        order, starts, suffix, stack, found = order[::-1].tolist(), (len(order) - starts).tolist(), self.suffix.tolist(), [0], []
        while stack:
            v = stack.pop()
            if suffix[v] >= 0:
                found.append(suffix[v])
            else:  # the reversed list puts the least child on top
                stack += order[starts[v + 1] : starts[v]]
        rank = np.empty(self.n, dtype=np.int64)
        rank[found] = np.arange(self.n)
        return rank

    def extensions(self) -> Extensions:
        """Longest common prefixes of any two suffixes."""
        order, starts = self.children(np.arange(int(self.symbols.max()) + 1))
        order, at, ends, parent, depth = order.tolist(), starts[:-1].tolist(), starts[1:].tolist(), self.parent.tolist(), self.depth.tolist()
        first, tour, v = array("q", bytes(8 * len(parent))), array("q", [0]), 0
        while True:
            k = at[v]
            if k < ends[v]:
                at[v] = k + 1
                v = order[k]
                first[v] = len(tour)
            elif v:
                v = parent[v]
            else:
                break
            tour.append(depth[v])
        leaves = np.flatnonzero(self.suffix >= 0)
        place = np.empty(self.n, dtype=np.int64)
        place[self.suffix[leaves]] = np.frombuffer(first, dtype=np.int64)[leaves]
        return Extensions(np.frombuffer(tour, dtype=np.int64), place)


class Extensions:
    """Depth of the lowest common ancestor of leaves: the least depth of the Euler tour between them."""

    def __init__(self, tour: np.ndarray, place: np.ndarray) -> None:
        self.place = place
        self.tour = np.concatenate([tour, np.full(-len(tour) % BLOCK, tour.max())])
        grid = self.tour.reshape(-1, BLOCK)
        self.ahead = np.minimum.accumulate(grid, axis=1).ravel()
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while (1 << len(self.levels)) <= len(grid):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different suffixes the length of their common prefix."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        low, high = a // BLOCK, b // BLOCK
        out = np.minimum(self.behind[a], self.ahead[b])
        between = high - low - 1
        for level, least in enumerate(self.levels):
            at = np.flatnonzero((between >> level == 1))
            if len(at):
                out[at] = np.minimum(out[at], np.minimum(least[low[at] + 1], least[high[at] - (1 << level)]))
        same = np.flatnonzero(low == high)
        if len(same):
            x, end, least = a[same], b[same], self.tour[a[same]]
            for _ in range(BLOCK - 1):
                x = np.minimum(x + 1, end)
                least = np.minimum(least, self.tour[x])
            out[same] = least
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next one that is smaller: the longest Lyndon word at a place ends there."""
    r, n = rank.tolist(), len(rank)
    following = [n] * n
    for i in range(n - 2, -1, -1):
        j, x = i + 1, r[i]
        while j < n and r[j] > x:
            j = following[j]
        following[i] = j
    return np.array(following, dtype=np.int64)


def runs_in(stretches: list[np.ndarray], minimum: int, repeats: int) -> tuple[np.ndarray, ...]:
    """(stretch, start, length, period) of all runs of the stretches, ordered by these columns without the length."""
    sizes = np.array([len(x) for x in stretches])
    _, codes = np.unique(np.concatenate(stretches), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.empty(len(owner), dtype=np.int64)
    ends = starts + sizes
    real = np.ones(len(text), dtype=bool)
    real[ends] = False
    text[real], text[ends] = codes + len(sizes), np.arange(len(sizes))  # separators are the least symbols
    n, top = len(text), int(text.max()) + 1
    order = np.arange(top)
    tree = SuffixTree(text.tolist())
    places = np.flatnonzero(real)
    found_at, found_period = [], []
    for o in (order, np.where(order < len(sizes), order, top + len(sizes) - order)):
        period = _next_smaller(tree.ranks(o))[places] - places
        able = period * repeats <= sizes[owner[places]]
        found_at.append(places[able])
        found_period.append(period[able])
    at, period = np.concatenate(found_at), np.concatenate(found_period)
    if not len(at):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    ahead = tree.extensions().of(at, at + period)
    del tree
    # the reversal of all but the last separator, closed by that separator again
    back = SuffixTree([*text[: n - 1][::-1].tolist(), int(text[n - 1])]).extensions()
    behind = np.zeros(len(at), dtype=np.int64)
    inner = np.flatnonzero(at > 0)
    behind[inner] = back.of(n - 1 - at[inner], n - 1 - at[inner] - period[inner])
    start, length = at - behind, behind + period + ahead
    good = (length >= minimum) & (length >= repeats * period)
    rows = np.unique(np.stack([owner[start[good]], start[good] - starts[owner[start[good]]], period[good], length[good]]), axis=1)
    return rows[0], rows[1], rows[3], rows[2]


def stretches_of(codes: np.ndarray, text_of: np.ndarray, minimum: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind the last) word of each stretch that can hold a run; ``text_of`` is the text of each word, rising."""
    size = minimum * (repeats - 2) // repeats + 1
    if len(codes) < minimum:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    grams = np.zeros(len(codes) - size + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            grams = mix64(grams + codes[j : len(codes) - size + 1 + j].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(text_of[: len(grams)] == text_of[size - 1 :])
    group = text_of[at]
    while len(at):
        with np.errstate(over="ignore"):
            key = grams[at] + mix64(group.astype(np.uint64) + np.uint64(7))
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        equal = np.zeros(len(at) + 1, dtype=bool)
        equal[1:-1] = sorted_key[1:] == sorted_key[:-1]
        keep = np.zeros(len(at), dtype=bool)
        keep[order] = equal[1:] | equal[:-1]
        # consecutive grams of one group form a stretch; one too short for a run goes
        kept, old = at[keep], group[keep]
        if not len(kept):
            return kept, kept
        fresh = np.ones(len(kept), dtype=bool)
        fresh[1:] = (kept[1:] != kept[:-1] + 1) | (old[1:] != old[:-1])
        piece = np.cumsum(fresh) - 1
        long = np.bincount(piece)[piece] >= minimum - size + 1
        if keep.all() and long.all():
            break
        at, group = kept[long], piece[long]
    if not len(at):
        return at, at
    fresh = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return at[fresh], np.append(at[fresh[1:] - 1], at[-1]) + size


def _find(minimum: int, repeats: int):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def part(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        counts, words = split_words(texts)
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        text_of = np.repeat(np.arange(len(counts)), counts)
        begin, end = stretches_of(codes, text_of, minimum, repeats)
        found, held, total = [], [], 0
        for k in range(len(begin)):
            held.append(k)
            total += end[k] - begin[k]
            if total >= TREE_WORDS or k == len(begin) - 1:
                which, start, length, period = runs_in([codes[begin[x] : end[x]] for x in held], minimum, repeats)
                found.append((np.array(held)[which], start, length, period))
                held, total = [], 0
        which, start, length, period = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 4
        start = begin[which] + start  # still counted over the slice; stretches rise, so runs are in order
        turn = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(turn, start + period, 1)
        np.add.at(turn, start + length, -1)
        kept = np.flatnonzero(np.cumsum(turn[:-1]) == 0)
        text = text_of[start]
        left = np.concatenate([[0], np.cumsum(np.bincount(text_of[kept], minlength=len(counts)))])
        lists = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.take(pa.array(kept)))
        per_text = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(counts)))]).astype(np.int32), pa.int32())
        runs = pa.ListArray.from_arrays(per_text, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - firsts[text], length, period)], fields=list(run)))
        return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), runs, pc.binary_join(lists, pa.scalar(" ", pa.large_string()))], names=["doc_id", "n_words", "runs", "collapsed"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, limit=SLICE):
                yield part(piece.column(0), text_array(piece))
        give_back()

    return task


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", minimum: int = 24, repeats: int = 3) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the periodic runs of each text's words.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  ``runs`` lists
    ``(start, length, period)`` by start, then period: stretches of smallest
    period ``period`` and at least ``max(minimum, repeats * period)`` words
    that no neighbouring word extends (``repeats`` is 2 or more).
    ``collapsed`` joins with one space the words that no run holds after its
    first period.  Null and empty texts have no words, no runs and an empty
    ``collapsed``; rows with a null id, repeated ids or repeated texts are
    handled each by itself; other columns are not read; an empty table gives
    an empty result.  A text is handled whole by one task: a very long one
    takes about 700 bytes a word where most of it may be periodic, and some 60
    bytes a word elsewhere.
    """
    if repeats < 2 or minimum < repeats:
        raise ValueError("runs need at least two periods")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(_find(minimum, repeats), layout)
