"""Best-fit packing of token sequences, large items first.

Documents are tokenised once, closed by END, and cut only if longer than the capacity.
Lengths are integers up to the capacity, so the plan is made on the histogram of lengths (a
row a length), however many documents there are:

* Large-item matching: pieces above a third of the capacity fit at most twice into a bin;
  from the longest down, each is paired with the longest large piece that still fits.
* Smaller pieces, from the longest down, best-fit the remaining gaps: each goes to the
  bins with the smallest gap that holds it; where none does, a new bin is opened.

The plan says, for each length, which ranks go to which kind of bin, and where in it. Pieces
get their rank within their length by counting (length, salt) groups, so a length that a
third of all rows share is ranked by many tasks.

The plan's size depends on the capacity C alone, and so it may be broadcast. A step of the plan ends a length
or uses up a run of equal gaps, and leaves at most one new run, whose gap is less than half as large: a
run is used up log2(C) times at most. A length opens three runs at most (its bins, the rest of a run, the rest
of its pieces). That makes 3 C log2(C) steps, with at most C / length rows each.

Nulls: a null text counts as empty and gives the one token END. Repeated rows and tied doc_ids
are packed each on its own. An empty table gives no pieces. Very long texts are cut
into full pieces after a first, shorter one. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

CAPACITY, END, SALTS = 2048, 0, 64
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks; it gives the same ids, several times faster.
RANKS, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}


def load_tokenizer(ranks: str = RANKS, special: dict[str, int] | None = None):
    """The encoder that gives the ids of TOKENIZER with add_special_tokens=False: strings of
    special tokens in a text become their ids, as that library does by default."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL if special is None else special)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter."""
    head = n % capacity or min(n, capacity)
    out, at = [(0, head)], head
    while at < n:
        out.append((at, capacity))
        at += capacity
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    shared.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_tokenizer()
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.append(encoder.encode_to_numpy(text.as_py() or "", allowed_special="all"), END).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    row = [doc_id, k, start, length, zlib.crc32(part.tobytes())]
                    for column, value in zip(out, [*row, part.astype(np.int32)] if with_ids else row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """From {length: count} the plan: rows (length, first rank, count, first bin, offset),
    saying that `count` pieces of a length, from that rank on, go to bins numbered on from
    `first bin`, at that offset; and the number of bins."""
    slots: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(histogram, 0)
    left = dict(histogram)
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first bin, count)

    def put(length: int, count: int, first: int, offset: int) -> None:
        slots.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count

    def opened(gap: int, first: int, count: int) -> None:
        if gap and count:
            gaps.setdefault(gap, []).append((first, count))

    large = sorted((x for x in histogram if 3 * x > capacity), reverse=True)
    for a in large:
        while left[a]:
            mate = next((b for b in large if b <= capacity - a and left[b] - (b == a) > 0), None)
            count = left[a] if mate is None else left[a] // 2 if mate == a else min(left[a], left[mate])
            put(a, count, bins, 0)
            if mate is not None:
                put(mate, count, bins, a)
            opened(capacity - a - (mate or 0), bins, count)
            bins += count
    for s in sorted((x for x in histogram if 3 * x <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s), default=None)
            if gap is None:
                each = capacity // s
                whole, rest = divmod(left[s], each)
                first, count, gap, each = (bins, whole, capacity, each) if whole else (bins, 1, capacity, rest)
                bins += count
            else:
                first, count = gaps[gap].pop()
                each = gap // s
                if left[s] < each:
                    fill, each = 1, left[s]
                else:
                    fill = min(count, left[s] // each)
                if fill < count:
                    gaps[gap].append((first + fill, count - fill))
                if not gaps[gap]:
                    del gaps[gap]
                count = fill
            for k in range(each):
                put(s, count, first, capacity - gap + k * s)
            opened(gap - each * s, first, count)
    return slots, bins


def assign(items: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1..capacity. items is read three
    times: it should be a written table."""
    # One row a length and salt: at most capacity * SALTS.
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots, _ = plan_bins(histogram, capacity)
    slots.sort()
    plan = items.sparkSession.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 5))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys))
    ranked = salted.withColumn("_number", number).join(offsets, ["length", "_salt"])
    ranked = ranked.select(*items.columns, (F.col("_before") + F.col("_number") - 1).alias("_rank"))
    columns = items.columns
    schema = items.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        lengths = table[:, 0]
        # Ranks of all lengths on one line, so that one search finds each piece's slot.
        wide = int(table[:, 1].max(initial=0) + table[:, 2].max(initial=0)) + 1
        line = lengths * wide + table[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("_rank").to_numpy(zero_copy_only=False)
            slot = np.searchsorted(line, length * wide + rank, side="right") - 1
            sequence = table[slot, 3] + rank - table[slot, 1]
            kept = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(table[slot, 4])], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return assign(shared.materialise(pieces(docs, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int>, starts array<int> (where
    each piece begins). A sequence is at most `capacity` tokens, so groups are bounded."""
    placed = assign(shared.materialise(pieces(docs, capacity, with_ids=True), "pieces"), capacity)
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"].cast("int")).alias("starts")
    )
