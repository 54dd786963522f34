"""Exact dedup as a stateful stream.

Rows enter as keys (digest of the normalised text, stable identifier, content locator).
A streaming aggregation keyed by digest keeps, in a RocksDB state store without
watermark or expiry, the row to keep and the group's size; later runs over the
same state folder go on from there. A digest that is hit is no proof: the texts of
all hits are read again at their locator (the file they were read from, and their doc_id) and grouped by
their full bytes; digests that hold more than one text are resolved by the texts themselves.

Texts are equal when identical after deleting SEPARATORS. Of equal texts the row with
the most code points stays, then the smallest doc_id. Null texts count as empty, null
doc_ids sort after all others; rows that agree in doc_id and text too are told apart by
the order in which they were read, and one stays. Very long texts are hashed and compared whole.
An empty table gives no rows. Extra columns are not read, and kept by drop_copies, whatever their names.
Copies of one text are summed in each task before they are sent, so a text that a third
of all rows hold costs a row per task; rows meet their group by shared.meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: files grow as they are written, none is laid out ahead.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in shared.SEPARATORS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def key_rows(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What the stream takes for each row: no text. uid tells apart rows that agree in all else."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(normalised(F.col("text"))).alias("digest"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.input_file_name().alias("locator"),
        F.monotonically_increasing_id().alias("uid"),
    )


def _best() -> Column:
    """The row to keep, as the minimum of a struct: most code points, smallest doc_id (a null last), first read."""
    return F.min(F.struct((-F.col("n_chars")).alias("minus"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"), F.col("locator")))


def run_stream(spark: SparkSession, keys_dir: str, state_dir: str, out_dir: str, max_files: int | None = None) -> None:
    """Folds all key files not yet seen into the state and writes the groups that changed, a folder a batch."""
    had = {k: spark.conf.get(k, None) for k in ROCKSDB}
    schema = spark.read.parquet(keys_dir).schema
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        reader = spark.readStream.schema(schema)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        groups = reader.parquet(keys_dir).groupBy("digest").agg(_best().alias("best"), F.count("*").alias("group_size"))

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

        query = groups.writeStream.outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def groups_of(spark: SparkSession, out_dir: str) -> DataFrame:
    """The state as last written: one row a digest."""
    rows = spark.read.parquet(out_dir)
    return rows.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s")).select("digest", "s.best", "s.group_size")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, max_files: int | None = None) -> DataFrame:
    """One row a document: doc_id, uid (where it was read, unique in a run), keep_id, group_size, kept, digest."""
    spark = docs.sparkSession
    keys_dir, out_dir, state_dir = (shared.scratch(spark, n) for n in ("keys", "groups", "state"))
    key_rows(docs, digest).write.parquet(keys_dir)
    keys = spark.read.parquet(keys_dir)
    total = keys.count()
    if not total:
        return keys.select("doc_id", "uid", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    run_stream(spark, keys_dir, state_dir, out_dir, max_files)
    groups = groups_of(spark, out_dir).select("digest", F.col("group_size").alias("n"), "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"))
    met = shared.materialise(shared.meet(keys.select("doc_id", "uid", "locator", "digest"), groups, "digest", total), "met")
    result = met.select("doc_id", "uid", "keep_id", "group_size", (F.col("keep_uid") == F.col("uid")).alias("kept"), "digest")

    # Full bytes on hits: the texts of groups of two and more, each task sending a text once.
    hits = met.where("group_size > 1").select(F.col("doc_id").alias("hit_id"), F.col("locator").alias("hit_at"), F.col("digest").alias("hit_digest")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.input_file_name().alias("locator"), "text")
    texts = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("locator") == F.col("hit_at"))).select("hit_digest", normalised(F.col("text")).alias("bytes"))
    # A doc_id that occurs with other texts in that file brings those in; their own digest leaves them out.
    texts = texts.groupBy("hit_digest", "bytes").agg(F.count("*").alias("n")).where(digest(F.col("bytes")) == F.col("hit_digest"))
    clashing = shared.materialise(texts.groupBy("hit_digest").agg(F.count("*").alias("texts")).where("texts > 1").select("hit_digest"), "clashes")
    if clashing.isEmpty():
        return result
    return _by_bytes(docs, result, clashing, digest)


def _by_bytes(docs: DataFrame, result: DataFrame, clashing: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests that hold several texts: grouped anew by the texts themselves. uids are
    matched by the same rule that made them, over rows that agree in doc_id and text."""
    held = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        normalised(F.col("text")).alias("bytes"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.lit("").alias("locator"),
        F.monotonically_increasing_id().alias("uid"),
    ).withColumn("digest", digest(F.col("bytes")))
    held = shared.materialise(held.join(clashing, F.col("digest") == F.col("hit_digest"), "left_semi"), "held")
    groups = held.groupBy("bytes").agg(_best().alias("best"), F.count("*").alias("group_size"))
    split = held.join(groups, "bytes").select(
        "doc_id", "uid", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.uid") == F.col("uid")).alias("kept"), "digest"
    )
    return result.join(clashing, F.col("digest") == F.col("hit_digest"), "left_anti").unionByName(split)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns. The texts move once, by doc_id."""
    rows = shared.materialise(exact_dedup(docs).select("doc_id", "digest", "kept"), "judged")
    id_, digest_, n_, u_ = shared.free_names(docs.columns, "_id", "_digest", "_n", "_u")
    kept = rows.where("kept").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest_))
    own = sha256(normalised(F.col("text")))
    stay = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (own == F.col(digest_)), "left_semi")
    # A kept row that agrees in doc_id and text with another one brings that in too.
    twice = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("n > 1 AND kept")
    if twice.isEmpty():
        return stay
    stay = stay.withColumns({digest_: own, n_: -F.coalesce(F.length("text"), F.lit(0)), u_: F.monotonically_increasing_id()})
    stay = shared.materialise(stay, "repeated")
    best = stay.groupBy("doc_id", digest_).agg(F.min(F.struct(n_, u_)).alias("b")).select(F.col(f"b.{u_}").alias(id_))
    return stay.join(best, F.col(u_) == F.col(id_), "left_semi").select(*docs.columns)
