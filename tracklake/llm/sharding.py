"""Sharding along a Hilbert curve, in Spark expressions only.

Metadata dimensions (texts by frequency-free hashing of their value, numbers by sampled
quantiles) are quantised to 2^BITS steps; the cell's index on the Hilbert curve orders the
rows, and the order is cut into runs, one a shard, so a shard's files cover a compact region
of all dimensions and can be pruned by any of them. Law `rows`: shard sizes differ by one row
at most.

The rank in the whole order takes no global sort: rows are counted by cell and by SALTS
parts of a cell (by a hash of doc_id), the counts are summed up along the curve (at most
2^(BITS * dimensions) rows), and rows are numbered within (cell, part). A cell, source or
text that a third of all rows share is thus numbered by many tasks.

Nulls in a dimension have the step 0; a null doc_id is ranked before others; tied and
repeated rows get slots of their own (rows with one key in any order among themselves); null texts have
no bytes (size 1); long texts are not moved by op4, which ranks without them. An empty table gives no
rows. Extra columns are kept by shard_rows, whatever their names, unless they are called shard or slot,
which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

BITS, SALTS, SHARDS = 4, 64, 8
DIMENSIONS = ["lang", "source", "n_chars"]


def with_hilbert(df: DataFrame, coordinates: str, out: str, dimensions: int, bits: int) -> DataFrame:
    """Adds the index of array<int> coordinates on the Hilbert curve of that many dimensions
    and bits (Skilling's transposition), as folds over bit steps; a projection a phase."""
    steps = [(i, 1 << b) for b in range(bits - 1, 0, -1) for i in range(dimensions)]
    x, g, t = f"_{out}_x", f"_{out}_g", f"_{out}_t"

    def undo(x: Column, s: Column) -> Column:
        i, low = s["i"], s["q"] - 1
        here, zero = F.get(x, i), F.get(x, F.lit(0))
        on = here.bitwiseAND(s["q"]) != 0
        flip = zero.bitwiseXOR(here).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, k: F.when(k == 0, F.when(on, v.bitwiseXOR(low)).otherwise(v.bitwiseXOR(flip)))
            .when((k == i) & ~on, v.bitwiseXOR(flip))
            .otherwise(v),
        )

    pairs = lambda names, rows: F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))
    df = df.withColumn(x, F.aggregate(pairs("iq", steps), F.col(coordinates), undo) if steps else F.col(coordinates))
    # Gray encoding: each coordinate takes in those before it.
    df = df.withColumn(g, F.transform(x, lambda v, k: F.aggregate(F.slice(F.col(x), F.lit(1), k), v, lambda a, b: a.bitwiseXOR(b))))
    last = F.get(F.col(g), F.lit(dimensions - 1))
    twist = F.lit(0)
    for b in range(bits - 1, 0, -1):
        twist = twist.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    df = df.withColumn(t, twist)
    index = F.aggregate(
        pairs("bi", [(1 << b, i) for b in range(bits - 1, -1, -1) for i in range(dimensions)]),
        F.lit(0).cast("long"),
        lambda acc, s: acc * 2 + F.when(F.get(F.col(g), s["i"]).bitwiseXOR(F.col(t)).bitwiseAND(s["b"]) != 0, F.lit(1)).otherwise(F.lit(0)),
    )
    return df.withColumn(out, index).drop(x, g, t)


def cell_code(df: DataFrame, dimensions: list[str], bits: int) -> Column:
    """The steps 0..2^bits - 1 of all dimensions, packed into one long."""
    steps, kinds, out = 1 << bits, dict(df.dtypes), F.lit(0).cast("long")
    numbers = [d for d in dimensions if kinds[d] not in ("string", "boolean", "binary")]
    cuts: dict[str, list[float]] = {}
    if numbers:
        shares = [k / steps for k in range(1, steps)]
        row = df.agg(*(F.percentile_approx(F.col(d).cast("double"), shares, 1000).alias(d) for d in numbers)).first()
        cuts = {d: list(row[d] or []) for d in numbers}
    for d in dimensions:
        if d in cuts:
            at = F.lit(0)
            for c in cuts[d]:
                at = at + F.when(F.col(d).cast("double") >= F.lit(float(c)), F.lit(1)).otherwise(F.lit(0))
        else:
            at = F.when(F.col(d).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col(d)), F.lit(steps)))
        out = out * steps + at
    return out


def steps_of(code: str, dimensions: int, bits: int) -> Column:
    """The packed steps as array<int>."""
    low = F.lit((1 << bits) - 1)
    return F.array(*(F.shiftright(F.col(code), bits * k).bitwiseAND(low).cast("int") for k in range(dimensions - 1, -1, -1)))


def shard_rows(df: DataFrame, shards: int = SHARDS, dimensions: list[str] | None = None, bits: int = BITS, key: str = "doc_id") -> DataFrame:
    """Adds shard int and slot long (gapless from 0 in each shard, in curve order)."""
    dims = DIMENSIONS if dimensions is None else dimensions
    df = df.drop("shard", "slot")
    cell, part, number, rank, shard_, slot_ = shared.free_names(df.columns, "_cell", "_part", "_number", "_rank", "_shard", "_slot")
    rows = df.withColumns({cell: cell_code(df, dims, bits), part: F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")})
    parts = rows.groupBy(F.col(cell).alias("cell"), F.col(part).alias("part")).agg(F.count("*").alias("n"))
    cells = parts.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("at", steps_of("cell", len(dims), bits))
    cells = with_hilbert(cells, "at", "curve", len(dims), bits)
    # At most 2^(bits * dimensions) cells pass through this one task.
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_at"), F.sum("n").over(whole).alias("total"))
    inside = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("part_at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(cells, "cell").select(
        F.col("cell").alias(cell), F.col("part").alias(part), F.struct((F.col("cell_at") + F.col("part_at")).alias("first"), "total").alias(rank)
    )
    ranked = rows.withColumn(number, F.row_number().over(Window.partitionBy(cell, part).orderBy(key))).join(offsets, [cell, part])
    at, total = F.col(f"{rank}.first") + F.col(number) - 1, F.col(f"{rank}.total")
    q, r = F.floor(total / shards), total % shards
    long_rows = r * (q + 1)
    in_long = at < long_rows
    shard = F.when(in_long, F.floor(at / (q + 1))).otherwise(r + F.floor(F.try_divide(at - long_rows, q)))
    slot = F.when(in_long, at % (q + 1)).otherwise(F.try_mod(at - long_rows, q))
    return ranked.select(*df.columns, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


#: Rows of a file that write_shards writes.
FILE_ROWS = 1_000_000


def write_shards(df: DataFrame, path: str, file_rows: int = FILE_ROWS, **options: object) -> None:
    """The rows as one folder a shard, cut into files of file_rows rows in curve order, each of which a task
    sorts and writes: a file's footer covers a compact region of all dimensions."""
    rows = shard_rows(df, **options)
    run = shared.free_name(rows.columns, "_run")
    rows = rows.withColumn(run, F.floor(F.col("slot") / file_rows))
    rows.repartition("shard", run).sortWithinPartitions("shard", "slot").drop(run).write.partitionBy("shard").parquet(path)
