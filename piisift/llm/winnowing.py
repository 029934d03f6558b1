"""Document fingerprints by winnowing, in DataFrame functions only.

A text's words are hashed, and a cyclic polynomial rolls the hashes of ``k``
words into one per k-gram (grams double in length, so each pass is one
``zip_with``).  Of every ``window`` consecutive k-grams the least hash is
chosen, of equal ones the rightmost, and it is kept with its place.  So two
texts that share ``window + k - 1`` words in a row share a chosen hash at the
same place of that passage, and no passage of fewer than ``k`` words matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from piisift.functions.arrays import let

K, WINDOW = 5, 8
#: A key orders k-grams: 31 bits of the hash, then the place counted down from this.
LAST = (1 << 31) - 1
#: Ranges of ids a shuffle partition gets, so that partitions come out even.
RANGES = 4


def _turned(x: Column, bits: int) -> Column:
    bits %= 64
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits else x


def _rolled(left: Column, right: Column, by: int, turn: int) -> Column:
    """Hashes of ``left`` grams with the ``right`` grams that begin ``by`` words on, ``turn`` words long, appended."""
    n = F.greatest(F.size(left) - F.lit(turn), F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(by + 1), n), lambda a, b: _turned(a, turn).bitwiseXOR(b))


def word_hashes(text: Column) -> Column:
    """60 bits of MD5 of each word, in order."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 15), 16, 10).cast("long"))


def gram_hashes(hashes: Column, k: int) -> Column:
    """The cyclic-polynomial hash of every ``k`` consecutive hashes; with fewer, one of all of them (of none: none)."""

    def longer(ready: Column, have: int, digits: str) -> Column:
        if not digits:
            return ready
        double = _rolled(ready, ready, have, have)
        if digits[0] == "0":
            return let(double, lambda d: longer(d, 2 * have, digits[1:]))
        return let(double, lambda d: let(_rolled(d, hashes, 2 * have, 1), lambda e: longer(e, 2 * have + 1, digits[1:])))

    whole = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, x: _turned(acc, 1).bitwiseXOR(x))
    return F.when(F.size(hashes) >= k, longer(hashes, 1, f"{k:b}"[1:])).when(F.size(hashes) > 0, F.array(whole)).otherwise(hashes)


def _least(keys: Column, window: int) -> Column:
    """Least key of every ``window`` consecutive ones; of all, if fewer."""

    def wider(least: Column, have: int) -> Column:
        if have == window:
            return F.slice(least, F.lit(1), F.greatest(F.size(least) - F.lit(window - 1), F.lit(1)))
        by = min(have, window - have)
        ahead = F.slice(least, F.lit(by + 1), F.greatest(F.size(least) - F.lit(by), F.lit(0)))
        return let(F.zip_with(least, ahead, lambda a, b: F.least(a, b)), lambda bound: wider(bound, have + by))  # least() skips what is missing at the end

    return wider(keys, 1)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """``array<struct<hash, position>>``: the chosen k-grams, by position (the number of their first word).

    Null, empty and blank texts have an empty fingerprint; a text of fewer than
    ``k`` words has one hash of all its words, at position 0.
    """

    def chosen(grams: Column) -> Column:
        keys = F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 20).bitwiseAND(F.lit(LAST).cast("long")), 31).bitwiseOR(F.lit(LAST).cast("long") - i))
        places = F.transform(F.array_distinct(let(keys, lambda bound: _least(bound, window))), lambda x: (F.lit(LAST).cast("long") - x.bitwiseAND(F.lit(LAST).cast("long"))).cast("int"))
        return F.transform(places, lambda at: F.struct(F.get(grams, at).alias("hash"), at.alias("position")))

    hashes = word_hashes(F.coalesce(text, F.lit("")))
    return let(let(hashes, lambda h: gram_hashes(h, k)), chosen)


def as_text(prints: Column) -> Column:
    """A fingerprint as ``hash@position`` entries, hashes in hexadecimal, one space between."""
    return F.array_join(F.transform(prints, lambda p: F.concat(F.hex(p["hash"]), F.lit("@"), p["position"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Hashes that two fingerprints share, over all of theirs (0 to 1); 1 for two empty ones."""

    def share(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda both: F.when((F.size(x) + F.size(y)) == 0, F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both)))

    return let(F.array_distinct(a["hash"]), lambda x: let(F.array_distinct(b["hash"]), lambda y: share(x, y)))


def next_to_each_other(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, _range, _last, _hash``: texts dealt by ranges of ids, each range with the row that follows it.

    Ranges come from approximate quantiles of the ids, ``RANGES`` for each
    shuffle partition; only their bounds and least ids reach the driver.  The
    least row of a range is copied to the range before it (``_last``), that of
    the first range to the last.  Texts are exchanged once.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = [i / (RANGES * tasks) for i in range(1, RANGES * tasks)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, 100 * RANGES * tasks).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))]) if bounds else F.array().cast("array<int>")
    # binary search: how many bounds are not above the id (a null id is below all)
    number = F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(listed, low + s - 1) <= F.col("doc_id"), low + s).otherwise(low))
    rows = rows.withColumn("_range", number)
    least = sorted((r["_range"], r["m"]["doc_id"]) for r in rows.groupBy("_range").agg(F.min(F.struct("doc_id")).alias("m")).collect())
    chain = [(r, low, least[i - 1][0]) for i, (r, low) in enumerate(least)]
    chain = F.broadcast(spark.createDataFrame(chain, "_of int, _low long, _before int"))  # one row a range
    both = F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")), F.struct(F.col("_before").alias("r"), F.lit(True).alias("g")))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("_low")), both).otherwise(F.slice(both, 1, 1))
    dealt = rows.join(chain, F.col("_range") == F.col("_of")).select("doc_id", "text", F.explode(places).alias("p"))
    return dealt.select("doc_id", "text", F.col("p.r").alias("_range"), F.col("p.g").alias("_last"), F.xxhash64("text").alias("_hash")).repartition(tasks, "_range")


def fingerprint_edits(docs: DataFrame, part: int = 4, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, edited, prints, edited_prints, near_edited, near_next``: fingerprints that stand up to an edit.

    ``edited`` is the text with its last ``n // part`` code points replaced by
    the first as many (or all) of the next document by ascending id; the last
    one is followed by the first, a single one by itself.  Null texts count as
    empty.  Rows without an id come first, and rows that repeat an id follow
    each other by a hash of their texts.  Other columns are not read; an empty
    table gives an empty result.  All rows of one range of ids are sorted by
    one task (rows that repeat one id lie in one range).
    """
    rows = next_to_each_other(docs, id_col, text_col).select("*", fingerprint(F.col("text"), k, window).alias("prints"))
    order = Window.partitionBy("_range").orderBy("_last", "doc_id", "_hash")
    rows = rows.select("*", F.lead("text").over(order).alias("_next"), F.lead("prints").over(order).alias("_next_prints")).where(~F.col("_last"))
    size = F.floor(F.length("text") / part).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - size), F.substring("_next", F.lit(1), size))
    rows = rows.select("doc_id", "text", edited.alias("edited"), "prints", "_next_prints")
    rows = rows.select("*", fingerprint(F.col("edited"), k, window).alias("edited_prints"))
    near = [likeness(F.col("prints"), F.col(c)).alias(n) for c, n in (("edited_prints", "near_edited"), ("_next_prints", "near_next"))]
    return rows.select("doc_id", "text", "edited", "prints", "edited_prints", *near)
