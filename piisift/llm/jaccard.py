"""Jaccard join of word n-gram sets with a count-vector R-tree.

1. Every document's n-grams are hashed and made distinct.  Documents with the
   same set form one class; everything below works on classes.
2. Classes that can be similar are brought together without comparing all:
   the n-grams are hashed into groups, so many that two sets within the
   threshold must agree in at least one whole group of ``min_group`` or more
   n-grams (the groups outnumber the differences that the threshold allows).
   Equal groups meet by their digest.  Sizes are handled in bands; a class joins
   its own band and, where a partner can be larger, the next.
3. Classes that met in a band, directly or not, form a cluster.  A passage that
   many texts share makes large ones of unlike sets, so inside a cluster sketches
   are compared first: one or two bits an n-gram, each the parity of the n-grams
   that fall on it.  Two sketches differ in no more bits than the sets differ in
   n-grams, so a pair that differs in too many is dropped and no other.
4. Classes that are left, directly or not, form clusters again; these bring their
   whole sets.  Inside a cluster (large ones are dealt out as pairs of tiles) the
   group counts of each set are a point; an R-tree over the points bounds the
   overlap of a set with a whole box by the sum of coordinate minima.  Pairs that
   survive are verified on the full sets, unless already linked through others.
5. The verified links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piisift.functions.bloom import bloom_filter, passes
from piisift.llm.common import BASE, cut, give_back, mix64, split_words, stored, text_array, text_slices, word_hashes
from piisift.llm.components import connected_components

#: Ids to drop up to which their list is broadcast; beyond, the join exchanges both sides.
BROADCAST_ROWS = 1_000_000
GROUPS, LEAF, TILE_CLASSES, TILE_BYTES = 64, 16, 8192, 24 << 20
#: Text bytes handled at once.
SLICE = 2 << 20
#: Signatures that a task gathers before it deals them out, and n-grams whose signatures meet at once.
GATHERED, PART_NGRAMS = 1 << 20, 4 << 20


def ngram_hashes(counts: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes document by document, and how many each document has.

    ``counts``: words per document; ``words``: all word hashes in order.  A
    document with 1 to k-1 words has one n-gram, its whole sequence.
    """
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(ends - counts, counts)
    rolled = np.zeros(len(words), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(words))):  # the last words of a document take what is left of it, used only where the document is short
            rolled[: len(words) - j] = np.where(place[: len(words) - j] + j < counts[owner[: len(words) - j]], rolled[: len(words) - j] * BASE + words[j:], rolled[: len(words) - j])
        width = np.minimum(counts, k)[owner].astype(np.uint64)
        rolled = mix64(rolled + mix64(width))
    use = place <= np.maximum(counts[owner] - k, 0)
    hashes, owner = rolled[use], owner[use]
    sizes = np.bincount(owner, minlength=len(counts))
    start = 0
    for n in sizes:
        hashes[start : start + n].sort()
        start += n
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.bincount(owner[keep], minlength=len(counts))


class Bands:
    """Size bands and, for each, how many groups are needed for the threshold ``num/den``."""

    def __init__(self, num: int, den: int, widest: int = 1 << 40):
        self.num, self.den, self.known = num, den, {}
        starts = [1]
        while starts[-1] < widest:
            starts.append(max(starts[-1] + 1, ceil(1.25 * starts[-1])))
        self.starts = np.array(starts, dtype=np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The band of each size."""
        return np.searchsorted(self.starts, sizes, side="right") - 1

    def need(self, total):
        """Least overlap of two sets whose sizes sum to ``total``: num * union <= den * overlap."""
        return -(-self.num * total // (self.den + self.num))

    def groups(self, band: int) -> tuple[int, int, int]:
        """(groups, differences allowed, least n-grams in a group that is emitted)."""
        if band not in self.known:
            self.known[band] = self._groups(band)
        return self.known[band]

    def _groups(self, band: int) -> tuple[int, int, int]:
        low, top = -(-int(self.starts[band]) * self.num // self.den), int(self.starts[band + 1]) - 1  # the smallest set that joins, the largest
        allowed = max(t - 2 * self.need(t) for t in range(max(2, 2 * top - 60), 2 * top + 1))
        for least in (4, 3, 2, 1):
            for m in range(allowed + 1, 2 * allowed + 2):
                weak = sum(exp(-low / m) * (low / m) ** i / factorial(i) for i in range(least))
                if m - allowed - 1 >= m * weak + sqrt(m * weak):
                    return m, allowed, least
        return 2 * allowed + 2, allowed, 1


def signatures(hashes: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of all documents in order, how many each has)."""
    sig, doc, _ = banded_signatures(hashes, sizes, bands)
    order = np.argsort(doc, kind="stable")
    return sig[order], np.bincount(doc, minlength=len(sizes))


def banded_signatures(hashes: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, the document of each, its band).

    Two sets within the threshold share a signature.  Both use the same groups
    of the larger one's band and differ in at most ``allowed`` of ``m`` groups;
    if either has fewer than ``m - allowed`` weak groups (below ``least``), one
    of the equal groups is strong, and both emit it.  A document that has more
    weak groups emits for a second, third, ... hash as well, until it has not.
    """
    out_sig, out_doc, out_band = [], [], []
    own = bands.of(sizes)
    starts = np.cumsum(sizes) - sizes
    reach = sizes * bands.den // bands.num  # the largest partner
    for step in (0, 1):
        docs = np.flatnonzero((sizes > 0) & ((step == 0) | (reach >= bands.starts[np.minimum(own + 1, len(bands.starts) - 1)])))
        band = own[docs] + step
        apart = np.array([bands.groups(int(b))[1] for b in band], dtype=np.int64) > 0  # else only equal sets are similar
        docs, band, seed = docs[apart], band[apart], 0
        while len(docs):
            seed += 1
            n = sizes[docs]
            m, allowed, least = (np.array([bands.groups(int(b))[i] for b in band], dtype=np.int64) for i in range(3))
            local = np.repeat(np.arange(len(docs)), n)
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[docs], n)
            h = mix64(hashes[at] + np.uint64(seed * 0x51ED2701))
            group = ((h >> np.uint64(40)).astype(np.int64) * m[local]) >> 24
            base = np.cumsum(m) - m
            slot = base[local] + group
            filled = np.bincount(slot, minlength=int(m.sum()))
            digest = np.zeros(int(m.sum()), dtype=np.uint64)
            np.add.at(digest, slot, mix64(h))
            of = np.repeat(np.arange(len(docs)), m)
            strong = filled >= least[of]
            number = np.arange(int(m.sum())) - base[of]
            key = digest ^ mix64((band[of].astype(np.uint64) << np.uint64(40)) ^ (number.astype(np.uint64) << np.uint64(8)) ^ np.uint64(seed % 251))
            out_sig.append(mix64(key + filled.astype(np.uint64))[strong])
            out_doc.append(docs[of[strong]])
            out_band.append(band[of[strong]])
            weak = m - np.bincount(of[strong], minlength=len(docs))
            again = weak >= m - allowed
            docs, band = docs[again], band[again]
    none = np.zeros(0, np.int64)
    return np.concatenate([*out_sig, np.zeros(0, np.uint64)]), np.concatenate([*out_doc, none]).astype(np.int64), np.concatenate([*out_band, none]).astype(np.int64)


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of all documents' sketches in order, how many each has): bit i is the parity of the hashes that end in i.

    A power of two of bits, at least as many as hashes and 64; no hashes, no sketch.
    """
    width = np.where(sizes > 0, 1 << np.ceil(np.log2(np.maximum(sizes, 64) / 64)).astype(np.int64), 0)
    begins = np.repeat((np.cumsum(width) - width) * 64, sizes)
    bit = (hashes & (np.repeat(width, sizes).astype(np.uint64) * np.uint64(64) - np.uint64(1))).astype(np.int64)
    odd = np.bincount(begins + bit, minlength=int(width.sum()) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64), width


def _documents(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices with their distinct n-gram hashes, set sizes and class ids (a digest of the set)."""
    for part in text_slices(batch, limit=SLICE):
        counts, words = split_words(text_array(part), lower=True)
        coded = words.dictionary_encode()
        hashed = word_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        hashes, sizes = ngram_hashes(counts, hashed, k)
        cls = np.zeros(len(sizes), dtype=np.uint64)
        np.add.at(cls, np.repeat(np.arange(len(sizes)), sizes), mix64(hashes ^ np.uint64(0x6A09E667F3BCC908)))
        yield part, hashes, sizes, mix64(cls + sizes.astype(np.uint64)).view(np.int64)


def _first_of_each(cls: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Whether a class comes for the first time and is not in ``seen``."""
    fresh = np.zeros(len(cls), dtype=bool)
    fresh[np.unique(cls, return_index=True)[1]] = True
    return fresh & ~np.isin(cls, seen)


def _fingerprints(k: int, num: int, den: int):
    """Set sizes, bands, classes and sketches; of a class only the first document of the task brings its sketch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part, hashes, sizes, cls in _documents(batch, k):
                fresh = _first_of_each(cls, seen)
                seen = np.concatenate([seen, cls[fresh]])
                bits, width = sketches(hashes[np.repeat(fresh, sizes)], np.where(fresh, sizes, 0))
                ends = np.concatenate([[0], np.cumsum(width * 8)]).astype(np.int32)
                sketch = pa.Array.from_buffers(pa.binary(), len(cls), [None, pa.py_buffer(ends), pa.py_buffer(bits)])
                columns = [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(bands.of(sizes), pa.int64()), pa.array(cls, pa.int64()), sketch]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "band", "cls", "sketch"])
        give_back()

    return task


def _dealt_signatures(k: int, num: int, den: int, parts: int):
    """Signatures by part, packed: runs of one node (a class in a band) with their lengths, and 40 bits of each signature.

    40 bits and the part tell nearly all signatures apart; where they do not,
    classes meet that need not, and are told apart later (32 bits would let
    enough meet to make one cluster of all bands).  Of a class only the first
    document of the task brings its signatures.
    """

    def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sig, node = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        part = ((sig >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((node, part))
        sig, node, part = sig[order], node[order], part[order]
        run = np.ones(len(sig), dtype=bool)
        run[1:] = (node[1:] != node[:-1]) | (part[1:] != part[:-1])
        run[:: 1 << 15] = True  # so that lengths fit in 16 bits
        run = np.flatnonzero(run)
        number, at = np.unique(part, return_index=True)
        at, of = np.append(at, len(sig)), np.searchsorted(run, np.append(at, len(sig)))
        lengths = np.diff(np.append(run, len(sig))).astype(np.uint16)
        columns = [pa.array(number, pa.int32())]
        for values, cuts in ((node[run], of), (lengths, of), (sig.astype(np.uint32), at), ((sig >> np.uint64(32)).astype(np.uint8), at)):
            columns.append(pa.array([values[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["part", "nodes", "lengths", "low", "high"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, held = Bands(num, den), np.zeros(0, dtype=np.int64), []
        for batch in batches:
            for _, hashes, sizes, cls in _documents(batch, k):
                fresh = _first_of_each(cls, seen)
                seen = np.concatenate([seen, cls[fresh]])
                sig, doc, band = banded_signatures(hashes[np.repeat(fresh, sizes)], np.where(fresh, sizes, 0), bands)
                held.append((sig, cls[doc] ^ band))
                if sum(len(h[0]) for h in held) >= GATHERED:
                    yield dealt(held)
                    held = []
        if any(len(h[0]) for h in held):
            yield dealt(held)
        held = []
        give_back()

    return task


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed signatures sorted by part -> distinct pairs (node, least node of its signature); memory is one part."""

    def met(held: list[list[bytes]]) -> pa.RecordBatch:
        nodes, lengths, low, high = (np.frombuffer(b"".join(h[i] for h in held), dtype=t) for i, t in enumerate((np.int64, np.uint16, np.uint32, np.uint8)))
        sig = high.astype(np.uint64) << np.uint64(32) | low
        node, order = np.repeat(nodes, lengths), np.argsort(sig)
        same = sig[order][1:] == sig[order][:-1]
        order = order[np.append(same, False) | np.append(False, same)]  # most signatures are nobody else's
        order = order[np.lexsort((node[order], sig[order]))]
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), dtype=bool)
        new[1:] = sig[1:] != sig[:-1]
        hub = node[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
        pairs = np.unique(np.stack([node, hub], axis=1)[node != hub], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["u", "v"])

    key, held = None, []
    for batch in batches:
        for part, *packed in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if part != key and held:
                yield met(held)
                held = []
            key = part
            held.append(packed)
    if held:
        yield met(held)
    held = []
    give_back()


def alike_within(cls: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], side: np.ndarray, guest: np.ndarray, bands: Bands) -> list[tuple[int, int]]:
    """Pairs whose sketches do not rule them out, enough to connect all such pairs.

    ``side`` tells the tiles of a pair apart (only cross pairs count then);
    two ``guest`` classes of a band meet in their own band.
    """
    order = np.argsort(sizes, kind="stable")
    cls, sizes, side, guest, bits = cls[order], sizes[order], side[order], guest[order], [bits[i] for i in order]
    width, label, links, cross = np.array([len(b) for b in bits]), np.arange(len(order)), [], bool(side.any())
    ends = np.searchsorted(sizes, sizes * bands.den // bands.num, side="right")
    for w in np.unique(width).tolist():
        first, last = np.searchsorted(width, [w, w + 1])
        # sketches of larger sets are folded to this width: a bit is then the parity of those laid on it
        rows = np.concatenate([_folded(bits, width, f, first, int(ends[last - 1]), w) for f in np.unique(width[first : ends[last - 1]]).tolist()])
        for i in range(first, last):
            js = np.arange(i + 1, ends[i])
            use = label[js] != label[i]
            if cross:
                use &= side[js] != side[i]
            if guest[i]:
                use &= ~guest[js]
            js = js[use]
            if not len(js):
                continue
            total = sizes[i] + sizes[js]
            apart = np.bitwise_count(rows[js - first] ^ rows[i - first]).sum(axis=1, dtype=np.int64)
            js = js[apart <= total - 2 * bands.need(total)]
            if len(js):
                others, at = np.unique(label[js], return_index=True)
                links += [(int(cls[i]), int(cls[j])) for j in js[at]]
                label[np.isin(label, others)] = label[i]
    return links


def _folded(bits: list[np.ndarray], width: np.ndarray, wide: int, first: int, end: int, narrow: int) -> np.ndarray:
    """The sketches of ``wide`` words among rows ``first`` to ``end``, folded to ``narrow`` words each."""
    a, b = np.clip(np.searchsorted(width, [wide, wide + 1]), first, end)
    return np.bitwise_xor.reduce(np.stack(bits[a:b]).reshape(b - a, -1, narrow), axis=1)


class CountTree:
    """A two-level R-tree over count vectors, packed by set size; boxes keep coordinate maxima and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels = []
        tops, least, most = points, sizes, sizes
        for _ in range(2):
            at = np.arange(0, len(tops), LEAF)
            tops, least, most = np.maximum.reduceat(tops, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((tops, least, most))

    def query(self, point: np.ndarray, size: int, bands: Bands) -> np.ndarray:
        """Indices of points whose bound reaches the overlap needed with a set of ``size``."""
        low, high = -(-size * bands.num // bands.den), size * bands.den // bands.num
        found = np.arange(len(self.levels[1][0]))
        for (tops, least, most), width in zip(reversed(self.levels), (len(self.levels[0][0]), len(self.sizes)), strict=True):
            bound = np.minimum(tops[found], point).sum(axis=1)
            found = found[(bound >= bands.need(size + np.maximum(least[found], low))) & (least[found] <= high) & (most[found] >= low)]
            found = (found[:, None] * LEAF + np.arange(LEAF)).ravel()
            found = found[found < width]
        n = self.sizes[found]
        found = found[(n >= low) & (n <= high)]
        bound = np.minimum(self.points[found], point).sum(axis=1)
        return found[bound >= bands.need(size + self.sizes[found])]


def count_points(sets: list[np.ndarray]) -> np.ndarray:
    """Group counts of each set, one row per set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    groups = (np.concatenate(sets) >> np.uint64(58)).astype(np.int64)
    return np.bincount(owner * GROUPS + groups, minlength=len(sets) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def links_within(cls: np.ndarray, sets: list[np.ndarray], side: np.ndarray, bands: Bands) -> list[tuple[int, int]]:
    """Verified links among the given classes, enough to connect all that are linked.

    ``side`` tells the tiles of a pair apart (only cross pairs are linked then).
    """
    points = count_points(sets)
    sizes = points.sum(axis=1, dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    tree, label, links = CountTree(points[order], sizes[order]), np.arange(len(order)), []
    side, cross = side[order], bool(side.any())
    for i in range(len(order)):
        near = tree.query(tree.points[i], int(tree.sizes[i]), bands)
        near = near[(near > i) & (label[near] != label[i])]
        if cross:
            near = near[side[near] != side[i]]
        for j in near:
            if label[j] == label[i]:
                continue
            both = np.concatenate([sets[order[i]], sets[order[j]]])
            both.sort()
            overlap = int(np.count_nonzero(both[1:] == both[:-1]))
            if bands.den * overlap < bands.num * (int(tree.sizes[i] + tree.sizes[j]) - overlap):
                continue
            links.append((int(cls[order[i]]), int(cls[order[j]])))
            label[label == label[j]] = label[i]
    return links


def _join_tiles(num: int, den: int, whole: bool):
    """Segments of equal (root, a, b), sorted by them -> links by whole sets or else pairs by sketches; memory is one pair of tiles."""

    def links_of(held: dict, bands: Bands) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        data, side, n, guest = zip(*held.values(), strict=True)
        cls, side = np.array([c for c, _ in held], dtype=np.int64), np.array(side)
        words = [np.frombuffer(d, dtype=np.uint64) for d in data]
        return links_within(cls, words, side, bands) if whole else alike_within(cls, np.array(n, dtype=np.int64), words, side, np.array(guest), bands)

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, key, held = Bands(num, den), None, {}
        for batch in batches:
            links: list[tuple[int, int]] = []
            for root, a, b, cls, tile, n, guest, data in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                if (root, a, b) != key:
                    links += links_of(held, bands)
                    key, held = (root, a, b), {}
                held[cls, guest] = (data, int(tile != a), n, guest)
            yield batch_of(links)
        yield batch_of(links_of(held, bands))
        held = {}
        give_back()

    return task


def _clusters(edges: DataFrame, nodes: DataFrame, size: Column) -> DataFrame:
    """Components of ``edges`` joined with ``nodes`` by ``node``: ``root, tiles`` and the other columns of ``nodes``.

    ``tiles``: so many that one holds ``TILE_CLASSES`` rows or ``TILE_BYTES`` of ``size`` on average.
    """
    members = connected_components(edges).withColumnRenamed("node", "_node").join(nodes, F.col("_node") == F.col("node")).drop("_node", "node")
    tiles = members.groupBy("root", (F.col("root") + F.lit(1)).alias("_r1")).agg(F.ceil(F.greatest(F.count("*") / TILE_CLASSES, F.sum(size) / TILE_BYTES)).cast("int").alias("tiles"))
    return members.join(tiles.select(F.col("root").alias("r"), "tiles"), F.col("root") == F.col("r")).drop("r")


def _links(rows: DataFrame, num: int, den: int, whole: bool) -> DataFrame:
    """Deals ``root, tiles, cls, n, guest, data`` out to pairs of tiles and joins inside each."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    dealt = rows.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("root", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "cls", "tile", "n", "guest", "data")
    dealt = dealt.repartition(partitions, "root", "a", "b").sortWithinPartitions("root", "a", "b")
    return dealt.mapInArrow(_join_tiles(num, den, whole), "u long, v long")


def _sets(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, sizes, cls in _documents(batch, k):
                ends = np.cumsum(sizes)
                data = [hashes[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)]
                same = part.column(1).to_numpy() == cls
                guest = np.zeros(len(data), dtype=bool)
                out = pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(1), pa.array(sizes, pa.int64()), pa.array(guest), pa.array(data, pa.binary())], names=["root", "tiles", "cls", "n", "guest", "data"])
                yield out.filter(pa.array(same))
        give_back()

    return task


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the smallest id reachable by links, its own included).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A text with 1 to
    k-1 words has one shingle, its whole sequence; empty, white or null texts
    have none and are linked with nothing.  Sets are compared by 64-bit shingle
    hashes.  Null ids never are a component id unless nothing else is there.
    Repeated rows are linked like any other copies.  Extra columns are not read.
    """
    num, den = threshold
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    thin = cut(source.mapInArrow(_fingerprints(k, num, den), f"doc_id {id_type}, text_hash long, n long, band long, cls long, sketch binary"))
    classes = thin.where("n > 0").groupBy("cls", "n", "band").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("d"), F.max("sketch").alias("sketch"))

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(partitions, (thin.agg(F.sum("n")).first()[0] or 0) // PART_NGRAMS)
    met = source.mapInArrow(_dealt_signatures(k, num, den, parts), "part int, nodes binary, lengths binary, low binary, high binary")
    met = cut(met.repartitionById(partitions, F.col("part") % partitions).sortWithinPartitions("part").mapInArrow(_meetings, "u long, v long"))

    # a class is a node in its own band and a guest in the next
    nodes = classes.select("cls", "n", F.col("sketch").alias("data"), "band", F.explode(F.array(F.lit(False), F.lit(True))).alias("guest"))
    nodes = nodes.select("cls", "n", "guest", "data", F.col("cls").bitwiseXOR(F.col("band") + F.col("guest").cast("long")).alias("node"))
    alike = cut(_links(_clusters(met, nodes, F.length("data")), num, den, whole=False))

    # one document per class of a cluster brings its whole set
    wanted = _clusters(alike, classes.select(F.col("cls").alias("node"), "cls", "n", "d"), F.col("n") * 8)
    wanted = stored(wanted.select("root", "tiles", "cls", F.col("d.doc_id").alias("i"), F.col("d.text_hash").alias("t")))
    held = bloom_filter(wanted, ["i", "t"])  # most texts are in no cluster and stay where they are, also where the list is too long to broadcast
    texts = source.where(passes(held, 0, lambda test: test(F.col("doc_id"), F.col("text_hash")))).join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t"))).select("text", "cls", "root", "tiles")
    sets = texts.mapInArrow(_sets(k), "root long, tiles int, cls long, n long, guest boolean, data binary")
    linked = connected_components(_links(sets, num, den, whole=True))

    named = classes.join(linked, F.col("cls") == F.col("node"), "left").select("cls", "n", F.col("d.doc_id").alias("least"), F.coalesce("root", "cls").alias("root"))
    ids = named.groupBy("root", (F.col("root") + F.lit(1)).alias("_r1")).agg(F.min("least").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    of_class = cut(named.join(ids, F.col("root") == F.col("r")).select("cls", "component_id").repartition(partitions, "cls", "component_id"))
    joined = thin.join(of_class.withColumnRenamed("cls", "c"), (F.col("cls") == F.col("c")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the near copies: of each component the rows with its smallest id stay, all columns kept."""
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    groups = similar_groups(docs, id_col=id_col, **options).groupBy(F.col("doc_id").alias("_gone")).agg(stays.alias("_stays"))
    gone = cut(groups.where(~F.col("_stays")).select("_gone"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)  # then the texts are not exchanged
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
