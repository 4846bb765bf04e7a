"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Every word shingle is hashed once; the hash's high bits name one of BINS bins and its other bits compete for the
bin's minimum. An empty bin takes the value of another: a sequence of bins, drawn by a hash of (bin, attempt), is
tried until one of them is not empty, so similar sets mostly take the same value; after ATTEMPTS misses (rare, even for
tiny sets) it takes one of the bins that have one, by a hash of the bin. Of each bin the low BITS bits are kept and packed as two hexadecimal digits.
Two unequal values agree in BITS bits by chance once in 2**BITS, which the likeness corrects for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscore.llm.common import ascii_lower, let, materialize, words_of

BINS, BITS, SHINGLE, ATTEMPTS = 128, 8, 5, 2048
#: The first attempts, written out one by one; then ends of further ones, that are made only for bins still empty.
_WRITTEN, _ENDS = 24, (128, 512, ATTEMPTS)
_SHIFT = 64 - BINS.bit_length() + 1
_LOW = (1 << _SHIFT) - 1
#: Odd multipliers of the hash that draws bins; fixed values, so that fingerprints can be compared over the years.
_DRAW = (0x9E3779B1, 0x85EBCA77)


def drawn(bin_: int | Column, attempt: int) -> int | Column:
    """The bin that an empty bin tries at an attempt: a 2-universal hash of both, modulo BINS."""
    mixed = (bin_ * _DRAW[0] + attempt * _DRAW[1] + bin_ * (attempt * 40503) + 12345) % 2147483647
    return F.shiftright(mixed, 7) % BINS if isinstance(mixed, Column) else (mixed >> 7) % BINS


def shingle_hashes(text: Column) -> Column:
    """A 64-bit hash of every five words in a row (of all words, if there are fewer; of none, if there are none)."""

    def of(hashed: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(hashed) - SHINGLE), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(hashed) >= SHINGLE, many).when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w)), of)


def low_bits(text: Column) -> Column:
    """BINS values of BITS bits, densified; an empty array for a text without words."""
    # One value above all others for each bin makes every bin present after the sort.
    top = F.array(*[F.lit(((b - BINS // 2) << _SHIFT) | _LOW) for b in range(BINS)])

    def minima(sorted_: Column) -> Column:
        firsts = F.filter(sorted_, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(sorted_, i - 1), _SHIFT)))
        return F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) != F.lit(_LOW), x.bitwiseAND(F.lit((1 << BITS) - 1)) - (1 << BITS - 1)))

    def densified(values: Column) -> Column:
        full = F.filter(values, lambda v: v.isNotNull())

        def fill(present: Column) -> Column:
            def later(b: Column, start: int, stop: int) -> Column:
                tried = F.transform(F.sequence(F.lit(start).cast("long"), F.lit(stop).cast("long")), lambda a: F.get(values, drawn(b, a).cast("int")))
                return F.get(F.filter(tried, lambda v: v.isNotNull()), F.lit(0))

            def of(v: Column, b: Column) -> Column:
                b = b.cast("long")
                first = [F.get(values, drawn(b, a).cast("int")) for a in range(1, _WRITTEN + 1)]
                more = [later(b, start + 1, stop) for start, stop in zip((_WRITTEN, *_ENDS), _ENDS, strict=False)]
                rest = F.get(present, F.pmod(F.xxhash64(b), F.size(present)).cast("int"))
                return F.coalesce(v, *first, *more, rest).cast("tinyint")

            return F.transform(values, of)

        return let(full, fill)

    def all_bins(hashes: Column) -> Column:
        return let(let(F.sort_array(F.concat(hashes, top)), minima), densified)

    return let(shingle_hashes(text), lambda h: F.when(F.size(h) > 0, all_bins(h)).otherwise(F.array().cast("array<tinyint>")))


def packed(bits: Column) -> Column:
    """The values as hexadecimal digits, two for each bin; '' for a text without words."""
    digits = F.array(*[F.lit(f"{v:02x}") for v in range(1 << BITS)])
    return F.array_join(F.transform(bits, lambda v: F.get(digits, v.cast("int").bitwiseAND(F.lit(255)))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the shingle sets' Jaccard likeness from two arrays of packed values, 0 to 1. Two texts without words are alike, one of them is like no other."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    both = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the column out: the packed fingerprint of each whole text; null texts count as empty, whose fingerprint is ''."""
    return docs.withColumn(out, packed(low_bits(F.coalesce(F.col(text), F.lit("")))))


def next_keys(keys: DataFrame) -> DataFrame:
    """keys (doc_id, h, n, distinct) with next_id, next_h: those of the row after it by (doc_id, h), of the first after the last.

    Rows are dealt by range and numbered within a range; the first of each range (one row a range) is the next of the
    last of the range before. No task orders all rows.
    """
    ranged = keys.repartitionByRange("doc_id", "h").select("*", F.spark_partition_id().alias("part"))
    ranged = materialize(ranged, "fingerprint-order")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    by_part = Window.orderBy("part")  # one row a range
    firsts = firsts.select("part", F.lead("first").over(by_part).alias("next_first"), F.first("first").over(by_part).alias("least"))
    firsts = firsts.select("part", F.coalesce("next_first", "least").alias("next_first"))
    own = ranged.withColumn("follows", F.lead(F.struct("doc_id", "h")).over(Window.partitionBy("part").orderBy("doc_id", "h")))
    joined = own.join(firsts, "part").select("doc_id", "h", "n", F.coalesce("follows", "next_first").alias("follows"))
    return joined.select("doc_id", "h", "n", F.col("follows.doc_id").alias("next_id"), F.col("follows.h").alias("next_h"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """The registered query: fingerprints of each text, of its edited text and of the next document's, and their likeness.

    Null texts count as empty. Rows that share doc_id and text are one document, returned once a row; rows that share
    doc_id only follow each other by a hash of their texts. A null doc_id comes first. Other columns are not used.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text"))
    keys = d.groupBy("doc_id", "h").agg(F.max(F.length("text")).alias("n"))
    order = next_keys(keys).withColumns({"key": F.xxhash64("doc_id", "h"), "next_key": F.xxhash64("next_id", "next_h")})
    full = d.select(F.xxhash64("doc_id", "h").alias("key"), "doc_id", "h", "text", low_bits(F.col("text")).alias("bits"))

    def same(a: str, b: str, id_: str = "doc_id", h: str = "h") -> Column:
        """Rows of one key that are of one document too; no key of the join, whose exchange both joins share."""
        ids = F.coalesce(F.col(f"{a}.doc_id").cast("long"), F.lit(-1)).bitwiseXOR(F.coalesce(F.col(f"{b}.{id_}").cast("long"), F.lit(-1)))
        return (F.col(f"{a}.h").bitwiseXOR(F.col(f"{b}.{h}")) == 0) & (ids == 0)

    # lag(), not row_number(): a limit on ranks would be pushed below the exchange, which both joins are to share.
    once = full.withColumn("again", F.lag(F.lit(1)).over(Window.partitionBy("key").orderBy("h"))).filter("again is null")
    gives = once.alias("d").join(order.alias("o"), (F.col("d.key") == F.col("o.next_key")) & same("d", "o", "next_id", "next_h"))
    head = gives.select(F.col("o.key").alias("key"), F.col("o.doc_id").alias("doc_id"), F.col("o.h").alias("h"), F.expr("substring(d.text, 1, int(o.n div 4))").alias("head"), F.col("d.bits").alias("next_bits"))
    both = full.alias("d").join(head.alias("e"), (F.col("d.key") == F.col("e.key")) & same("d", "e"))
    edited = F.expr("concat(substring(d.text, 1, int(length(d.text) - length(d.text) div 4)), e.head)")
    made = both.select(F.col("d.doc_id").alias("doc_id"), F.length("d.text").cast("long").alias("n_chars"), F.col("d.bits").alias("bits"), "next_bits", edited.alias("edited"))
    made = made.withColumn("edited_bits", low_bits(F.col("edited")))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("bits")).alias("fingerprint"),
        packed(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
    )
