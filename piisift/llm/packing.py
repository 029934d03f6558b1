"""Best-fit-decreasing packing of token sequences with a segment tree over remaining capacity.

Packing needs no shuffle: every task tokenises its own partition and packs it
pool by pool.  A pool holds a bounded number of tokens.  Documents longer than
a window are first cut into full windows; what is left of each, in descending
length, goes to the tightest open window that still has room.  The open windows
are found by a segment tree over remaining capacity (0..window), whose leaves
count the open windows of that capacity.  Windows that stay emptier than
``min_fill`` are handed on to the next pool; in the last pool of a task they
are closed by cutting (the contract allows free cuts): their pieces fill the
gaps of the others, and the last rest is laid out in powers of two, which are
not padded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piisift.llm.common import give_back, spans_of, text_array, text_slices

WINDOW, END_ID, POOL_TOKENS, MIN_FILL, CACHE_WORDS = 2048, 1, 2 << 20, 0.97, 300_000
#: Text bytes tokenised at once, and tokens of a batch of pieces: what a task holds besides its pool.
SLICE, OUT_TOKENS = 1 << 20, 1 << 18


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks a word that is encoded as it stands.
RAW = "\ue000"
#: Characters whose normalisation is at most lower-casing; a text with any other is cut into words only.
NOT_PLAIN = "[^\\x09-\\x0D\\x20-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<\\|"


def _kinds() -> np.ndarray:
    """Kind of each byte of plain text: 0 white space, 1 sign, 2 letter (all bytes of two-byte characters), 3 digit."""
    kinds = np.ones(256, dtype=np.uint8)
    kinds[[32, *range(9, 14)]] = 0
    kinds[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 2
    kinds[ord("0") : ord("9") + 1] = 3
    return kinds


KINDS = _kinds()


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts with a space between a run of letters, a run of signs and each digit."""
    data, ends = spans_of(texts)
    kinds = KINDS[data]
    before, after = kinds[:-1], kinds[1:]
    at = np.flatnonzero(((before != after) | (after == 3)) & (before > 0) & (after > 0)) + 1
    out = np.full(len(data) + len(at), 32, dtype=np.uint8)
    old = np.ones(len(out), dtype=bool)
    old[at + np.arange(len(at))] = False
    out[old] = data
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends + np.searchsorted(at, ends, side="left")), pa.py_buffer(out))


class WordTokenizer:
    """Token ids of texts, computed once per distinct piece and kept in a bounded dictionary.

    The tokenizer's pre-splitting never joins characters across white space.
    Arrow cuts plain texts into the pre-splitter's pieces (contractions, runs
    of letters, single digits, runs of signs) and codes them by distinct piece;
    new pieces are encoded many at a time (a word-end token closes each), and
    numpy gathers the ids.  Any other text is cut at ASCII white space and its
    distinct words are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.lengths = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        flats, lengths = [], []
        whole = [p for p in pieces if p.isascii() and p]
        tokenize = self.tokenizer.model.tokenize  # an ASCII piece stands for itself in the byte-level alphabet
        for k in range(0, len(whole), 20_000):
            ids = [[t.id for t in tokenize(p)] for p in whole[k : k + 20_000]]
            lengths.append(np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)))
            flats.append(np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(lengths[-1].sum())))
        plain = [p for p in pieces if not p.isascii() and p[0] != RAW]
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = self._ids(" ".join(part))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # some piece is not one pre-token: encode each alone
                each = [self._ids(p) for p in part]
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            flats.append(ids)
            lengths.append(np.diff(cuts, prepend=0))
        raw = [p for p in pieces if p[:1] in (RAW, "")]
        for p in raw:
            flats.append(self._ids(p[1:]))
            lengths.append(np.array([len(flats[-1])]))
        added = np.concatenate([*lengths, np.zeros(0)]).astype(np.int32)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(added, dtype=np.int64) - added])
        self.lengths = np.concatenate([self.lengths, added])
        self.flat = np.concatenate([self.flat, *flats])
        self.index.update(zip(whole + plain + raw, range(len(self.index), len(self.index) + len(pieces)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each followed by the end id; tokens per text)."""
        odd = pc.match_substring_regex(texts, NOT_PLAIN)
        lower = pc.utf8_lower(texts)
        cut = _spaced(lower)
        contracted = pc.match_substring(texts, "'")
        if pc.any(contracted).as_py():
            cut = pc.if_else(contracted, pc.replace_substring_regex(lower, r"('(?:s|t|re|ve|m|ll|d)|\pN|[^\x09-\x0D\x20\pL\pN]+)", r" \1 "), cut)
        if pc.any(odd).as_py():
            cut = pc.if_else(odd, pc.replace_substring_regex(texts, r"([^\x09-\x0D\x20]+)", RAW + r"\1"), cut)
        lists = pc.ascii_split_whitespace(cut)
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.index) > CACHE_WORDS:
            self._reset()
        self._learn([p for p in pieces if p not in self.index])
        entry = np.fromiter(map(self.index.__getitem__, pieces), dtype=np.int32, count=len(pieces))
        codes = entry[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum(self.lengths[codes], dtype=np.int64)
        text_ends = np.concatenate([[0], ends])[lists.offsets.to_numpy()[1:]]
        tokens = np.diff(text_ends, prepend=0) + 1
        out = np.full(int(tokens.sum()), END_ID, dtype=np.uint32)
        free = np.ones(len(out), dtype=bool)
        free[np.cumsum(tokens) - 1] = False
        out[free] = self._gather(codes)
        return out, tokens

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        parts = [np.zeros(0, dtype=np.uint32)]
        for k in range(0, len(codes), 1 << 20):
            part = codes[k : k + (1 << 20)]
            n = self.lengths[part]
            before = np.cumsum(n, dtype=np.int64) - n
            parts.append(self.flat[np.arange(n.sum()) + np.repeat(self.starts[part] - before, n)])
        return np.concatenate(parts)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaf c counts the windows with c tokens left."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with at least ``need`` left, removed from the tree: (window, its capacity)."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # climb until a right sibling has windows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window of each piece, tokens in each window); lengths are 1..window."""
    tree, place, used = OpenWindows(window), np.zeros(len(lengths), dtype=np.int64), []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found = (len(used), window)
            used.append(0)
        w, capacity = found
        place[i] = w
        used[w] += n
        if capacity > n:
            tree.add(capacity - n, w)
    return place, np.array(used, dtype=np.int64)


def _powers(total: int, window: int) -> list[int]:
    return [1 << b for b in range(window.bit_length() - 1, -1, -1) if total >> b & 1]


def fill_by_cutting(pieces: list[tuple[int, int]], gaps: list[tuple[int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Cuts ``pieces`` (key, length) into the ``gaps`` (window, room), then into new windows: (key, start, length, window).

    New windows are numbered -1, -2, ...: full ones first, the last rest in powers of two.
    """
    total = sum(n for _, n in pieces) - sum(n for _, n in gaps)
    new = [window] * max(0, total // window) + (_powers(total % window, window) if total > 0 else [])
    rooms = gaps + [(-1 - i, n) for i, n in enumerate(new)]
    out, k, left = [], 0, rooms[0][1] if rooms else 0
    for key, length in pieces:
        start = 0
        while start < length:
            while not left:
                k += 1
                left = rooms[k][1]
            n = min(left, length - start)
            out.append((key, start, n, rooms[k][0]))
            start += n
            left -= n
    return out


class TaskPacker:
    """Packs one task's documents pool by pool; ``add`` and ``finish`` yield rows of pieces."""

    def __init__(self, window: int, min_fill: float):
        self.window, self.min_fill, self.next = window, min_fill, TaskContext.get().partitionId() << 33
        self.docs: list[tuple] = []  # (doc_id, start, ids, tokens of its document) still to be packed
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        for start in range(0, len(ids), self.window):
            piece = ids[start : start + self.window]
            if len(piece) == self.window:
                yield doc_id, start, piece, len(ids), self.next, 0
                self.next += 1
            else:
                self.docs.append((doc_id, start, piece, len(ids)))
                self.tokens += len(piece)
        if self.tokens >= POOL_TOKENS:
            yield from self._pool(last=False)

    def finish(self) -> Iterator[tuple]:
        yield from self._pool(last=True)

    def _pool(self, last: bool) -> Iterator[tuple]:
        docs, window = self.docs, self.window
        lengths = np.array([len(d[2]) for d in docs], dtype=np.int64)
        place, used = best_fit_decreasing(lengths, window)
        filled = used >= self.min_fill * window
        powers = (used & (used - 1)) == 0
        done, moved = filled | powers, []
        if not last:
            moved = [docs[i] for i in np.flatnonzero(~done[place])]
        else:
            # empty the emptiest windows into the gaps of the others: the fullest open ones that their tokens can fill
            open_ = np.flatnonzero(~done)[np.argsort(-used[~done], kind="stable")]
            room, held = np.cumsum(window - used[open_]), np.cumsum(used[open_][::-1])[::-1]
            k = int(np.count_nonzero(room[:-1] <= held[1:])) if len(open_) else 0
            done[open_[:k]] = True
            loose = np.flatnonzero(~done[place])
            cuts = fill_by_cutting([(int(i), int(lengths[i])) for i in loose], [(int(w), int(window - used[w])) for w in open_[:k]], window)
        number = np.cumsum(done) - 1 + self.next
        offset = np.zeros(len(used), dtype=np.int64)
        for i in np.flatnonzero(done[place]):
            doc_id, start, ids, total = docs[i]
            w = place[i]
            yield doc_id, start, ids, total, int(number[w]), int(offset[w])
            offset[w] += len(ids)
        self.next += int(done.sum())
        if last:
            fresh: dict[int, int] = {}
            for i, at, n, w in cuts:
                doc_id, start, ids, total = docs[i]
                sequence = int(number[w]) if w >= 0 else self.next - 1 - w
                position = int(offset[w]) if w >= 0 else fresh.get(w, 0)
                yield doc_id, start + at, ids[at : at + n], total, sequence, position
                if w >= 0:
                    offset[w] += n
                else:
                    fresh[w] = position + n
        self.docs, self.tokens = moved, sum(len(d[2]) for d in moved)


def _gathered(pieces: Iterator[tuple]) -> Iterator[list[tuple]]:
    """The pieces in order, in lists of at most 4,096 and of ``OUT_TOKENS`` tokens or one piece more."""
    out, tokens = [], 0
    for piece in pieces:
        out.append(piece)
        tokens += len(piece[2])
        if len(out) == 4096 or tokens >= OUT_TOKENS:
            yield out
            out, tokens = [], 0
    if out:
        yield out


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, min_fill: float = MIN_FILL
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit, binary), ``doc_tokens, sequence_id, offset``.

    A document's tokens are its text's ids and one end id, so an empty or null
    text is the end id alone.  Null ids stay null; repeated rows are packed as
    often as they occur.  Extra columns are ignored.  An empty table gives no
    piece.  Windows at least ``min_fill`` full are padded; all others are a
    power of two long, so they need no padding.
    """
    path = tokenizer or default_tokenizer()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", _arrow(id_type)), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        doc_id, start, ids, total, sequence, offset = zip(*pieces, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_id, schema.field(0).type), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
            schema=schema,
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what the stage before has left in this worker
        words, packer = WordTokenizer(path), TaskPacker(window, min_fill)
        give_back()

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for part in text_slices(batch, limit=SLICE):
                    ids, tokens = words.encode(text_array(part))
                    ends = np.cumsum(tokens)
                    for doc_id, end, n in zip(part.column(0).to_pylist(), ends, tokens, strict=True):
                        yield from packer.add(doc_id, ids[end - n : end].copy())
            yield from packer.finish()

        yield from map(rows, _gathered(pieces()))
        del words, packer, pieces
        give_back()

    ddl = f"doc_id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return source.mapInArrow(task, ddl)


def _arrow(data_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)
