"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from piisift.session import checkpoint_dir, run_folder

#: A word: a longest run of characters outside space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text handled at once inside a task; a longer single text is one slice.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores before them, so many that no column is called so in any case."""
    taken = {c.lower() for c in columns}
    mark = "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared checkpoint folder and reads it back (lineage ends there)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table of its own in the shared folder and reads it back: like :func:`cut`, and the planner knows its size."""
    path = run_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spans_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, offsets of the texts in them) of a large string or binary array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def count_words(texts: pa.Array) -> np.ndarray:
    """Words per text, from its bytes: a word starts at a byte that is not white space and follows white space or the text's start."""
    data, ends = spans_of(texts)
    white = np.zeros(256, dtype=bool)
    white[[32, *range(9, 14)]] = True
    blank = white[data]
    first = ~blank
    first[1:] &= blank[:-1]
    begins = ends[:-1][np.diff(ends) > 0]
    first[begins] = ~blank[begins]
    return np.diff(np.searchsorted(np.flatnonzero(first), ends))


@F.arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Number of words of each text; null counts as empty."""
    batch = pa.RecordBatch.from_arrays([text], ["text"])
    counts = [count_words(text_array(part)) for part in text_slices(batch, limit=2 << 20)]
    give_back()
    return pa.array(np.concatenate([*counts, np.zeros(0, dtype=np.int64)]), pa.int64())


def give_back() -> None:
    """Returns freed memory to the system; the workers that ran a task stay for later ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about ``limit`` text bytes each, so memory is bounded by bytes, not rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_array(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with null as the empty text, 64-bit offsets (a batch may hold over 2 GB), data of its own.

    The copy matters: Arrow's ``ascii_lower`` gives wrong bytes for a slice of
    a large string array whose data does not begin at zero.
    """
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    return pa.concat_arrays([texts])


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(words per text, all words in order) under the ASCII word rule; ``lower`` folds A-Z only."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    keep = pc.not_equal(words, "")  # the splitter yields "" before a leading or after a trailing separator
    empty = np.flatnonzero(~keep.to_numpy(zero_copy_only=False))
    if len(empty):
        owner = np.repeat(np.arange(len(counts)), counts)[empty]
        counts -= np.bincount(owner, minlength=len(counts))
        words = words.filter(keep)
    return counts, words


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift) for uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
        return x ^ (x >> np.uint64(32))


#: An odd base for polynomial hashes modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def byte_values() -> np.ndarray:
    """One 64-bit value per byte, from the finaliser."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word's bytes, vectorised (polynomial over the bytes, then finalised with the length)."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    data, offsets = spans_of(words.cast(pa.large_binary()))
    starts, lengths = offsets[:-1], np.diff(offsets)
    with np.errstate(over="ignore"):
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, BASE, dtype=np.uint64))
        terms = np.concatenate([byte_values()[data] * powers[place], np.zeros(1, dtype=np.uint64)])
        sums = np.add.reduceat(terms, np.minimum(starts, len(data)))
        sums[lengths == 0] = 0
        return mix64(sums ^ mix64(lengths.astype(np.uint64)))
