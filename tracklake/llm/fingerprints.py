"""Document fingerprints: one-permutation MinHash, in Spark expressions only.

A text's five-word shingles (the whole sequence if shorter; A-Z lowered) are hashed once;
the top bits of a hash name its bin, and a bin keeps its least hash. Empty bins are
filled by optimal densification: each bin has its own pseudo-random order of all bins, the
same for every text, and takes the value of the first filled bin in that order.
Of each bin the low BITS bits are kept, one hex digit a bin. Likeness of two
fingerprints is the share of equal digits, corrected for chance: (share - 2^-b) / (1 - 2^-b),
held to 0..1.

Nulls and empty texts, or such without words: the fingerprint is the empty string, whose
likeness is 1 to itself and 0 to any other. Equal texts have equal fingerprints. Null
doc_ids come last in the order, by a hash of their text, the largest first; tied doc_ids are ordered by
text. A single document is its own next one. Very long texts are taken whole. An empty table gives no rows.
Extra columns are not read. Neighbours in doc_id order are met by one shuffle: rows go to ranges of doc_id, and
those without one to ranges of the hash (cut at values that occur, RANGES_PER_PARTITION times as many as
shuffle partitions), and the row at a cut goes to both ranges it touches. Only rows with one id, or without
an id and with one text, are bound to one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS, BINS, BITS = 5, 256, 4
PROBES, RANGES_PER_PARTITION = 16, 4
#: Per bin i: its t-th probe is bin (STEP[i] * t + START[i]) mod BINS; RANK inverts that.
_SEED = 0x9E3779B97F4A7C15
_RANDOM = [((i + 1) * _SEED * ((i + 1) * _SEED >> 29 | 1)) & (1 << 64) - 1 for i in range(BINS)]
STEP = [(r >> 40) % BINS | 1 for r in _RANDOM]
START = [(r >> 20) % BINS for r in _RANDOM]
INVERSE = [pow(s, -1, BINS) for s in STEP]
_SHIFT = 63 - (BINS.bit_length() - 1)
_LOW = (1 << _SHIFT) - 1


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>")


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn(out, F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of a text column. Each step is a projection of its own, so no
    array is computed more than once a row."""
    names = [f"_{out}{k}" for k in range(4)]
    words, hashes, least, filled = names
    df = with_words(df, text, words)
    last = F.size(words) - WORDS
    # 63-bit hashes of the shingles, and for each bin a largest value that stands for "empty".
    shingle = lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(WORDS)))
    hashed = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), shingle)).otherwise(F.array(F.xxhash64(words)))
    positive = F.transform(hashed, lambda h: h.bitwiseAND(F.lit((1 << 63) - 1)))
    df = df.withColumn(hashes, F.when(F.size(words) > 0, positive))
    marks = _longs([(b << _SHIFT) + _LOW for b in range(BINS)])
    df = df.withColumn(hashes, F.sort_array(F.concat(hashes, marks)))
    bin_of = lambda h: F.shiftright(h, _SHIFT)
    df = df.withColumn(
        least,
        F.filter(hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col(hashes), i - 1)))),
    )
    df = df.withColumn(least, F.transform(least, lambda h: F.when(h.bitwiseAND(F.lit(_LOW)) != F.lit(_LOW), h))).drop(hashes, words)
    df = df.withColumn(filled, F.filter(least, lambda h: h.isNotNull()))

    def dense(h: Column, i: Column) -> Column:
        step, start = F.get(_longs(STEP), i), F.get(_longs(START), i)
        probes = [F.get(F.col(least), F.pmod(step * t + start, F.lit(BINS)).cast("int")) for t in range(PROBES)]
        rank = lambda f: F.pmod((bin_of(f) - F.get(_longs(START), i)) * F.get(_longs(INVERSE), i), F.lit(BINS))
        rest = F.array_min(F.transform(filled, lambda f: F.struct(rank(f).alias("r"), f.alias("h"))))["h"]
        return F.coalesce(h, *probes, rest)

    digit = lambda h: F.substr(F.lit("0123456789abcdef"), h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + 1, F.lit(1))
    packed = F.array_join(F.transform(least, lambda h, i: digit(dense(h, i))), "")
    return df.withColumn(out, F.coalesce(F.when(F.size(filled) > 0, packed), F.lit(""))).drop(least, filled)


def likeness(a: str, b: str) -> Column:
    """Of two fingerprint columns."""
    both = F.size(
        F.filter(F.arrays_zip(F.split(F.col(a), "").alias("a"), F.split(F.col(b), "").alias("b")), lambda p: p["a"] == p["b"])
    )
    chance = 2.0**-BITS
    return (
        F.when(F.col(a) == F.col(b), F.lit(1.0))
        .when((F.col(a) == "") | (F.col(b) == ""), F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (both / F.lit(float(BINS)) - chance) / (1 - chance))))
    )


def _cuts(df: DataFrame, column: str, ranges: int) -> list[int]:
    """Values of a column that occur, each the largest of its range, the last the largest of all. Percentiles
    of large values are rounded to doubles: they part the ranges, whose maxima are then taken."""
    shares = [k / ranges for k in range(1, ranges + 1)]
    rough = sorted(set(df.agg(F.percentile_approx(column, shares, 10 * ranges)).first()[0] or []))
    if not rough:
        return []
    known = df.where(F.col(column).isNotNull())
    return sorted(r["most"] for r in known.groupBy(_place(column, rough)[0]).agg(F.max(column).alias("most")).collect())


def _place(column: str, cuts: list[int], group: int = 64) -> tuple[Column, Column]:
    """The range of a value (ranges ascend from 0), and whether it is its range's largest; by two short searches."""
    coarse, fine = F.lit(cuts[group - 1 :: group]).cast("array<bigint>"), F.lit(cuts).cast("array<bigint>")
    skip = (F.size(F.filter(coarse, lambda c: c < F.col(column))) * group) if len(cuts) >= group else F.lit(0)
    near = F.slice(fine, skip + 1, group)
    return skip + F.size(F.filter(near, lambda c: c < F.col(column))), F.array_contains(near, F.col(column))


def with_next(df: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """Adds next_<column>: the value of the next row in descending doc_id order, of the first row after the last."""
    df = df.withColumn("_none", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    ids, nones = _cuts(df, "doc_id", ranges), _cuts(df, "_none", ranges)
    place, first = F.lit(0), F.lit(False)
    if ids:
        place, first = _place("doc_id", ids)
        place = place + len(nones)
    if nones:  # below all ids
        low, low_first = _place("_none", nones)
        place, first = F.when(F.col("doc_id").isNull(), low).otherwise(place), F.when(F.col("doc_id").isNull(), low_first).otherwise(first)
    n = max(1, len(ids) + len(nones))
    # The first row of a range follows the last row of the range above, and is a guest there.
    own = F.struct(place.cast("int").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(place + 1, F.lit(n)).cast("int").alias("range"), F.lit(True).alias("guest"))
    spots = F.when(first, F.array(own, guest)).otherwise(F.array(own))
    rows = df.withColumn("_spot", F.explode(spots)).select("*", F.col("_spot.range").alias("_range"), F.col("_spot.guest").alias("_guest")).drop("_spot")
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("_none").desc(), F.col("text").asc_nulls_first())
    out = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return out.where("NOT _guest").drop("_range", "_guest", "_none")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and the likenesses; see the
    contract in queries.py. The edited text ends with the beginning of the next document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = RANGES_PER_PARTITION * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_next(with_fingerprint(rows, "text", "fingerprint"), ["text", "fingerprint"], ranges)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn(
        "edited", F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    ).select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "fingerprint", "next_fingerprint")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
