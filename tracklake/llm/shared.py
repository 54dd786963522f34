"""What several operators need: the cluster's shared folder, written tables, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every word-based operator: space, tab, LF, VT, FF, CR.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes A-Z to a-z; bytes.split() without arguments splits at exactly SEPARATORS.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only where that is
    unset and all run in this process (tests), a temporary folder of this driver."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tracklake-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage,
    survives lost executors and lets later steps read single columns."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: Iterable[str], name: str) -> str:
    """A column name like the one given that is not taken (Spark's names don't differ by case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    out: list[str] = []
    for n in names:
        out.append(free_name([*taken, *out], n))
    return out


def meet(rows: DataFrame, sums: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with sums(key, n, ...), where n is the rows of that key, total all rows; n is left out.
    Keys with more than a partition's share of the rows, fewer than there are partitions, are met by a
    broadcast, all others by a shuffle. Both inputs are read twice; null keys meet nothing."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.col("n") * parts > F.lit(total)  # fewer than `parts` keys
    names = [c for c in sums.columns if c not in (key, "n")]
    mark = free_name([*rows.columns, *sums.columns], "_hot")
    marked = rows.join(F.broadcast(sums.where(hot).select(key, F.struct(F.lit(True).alias("is"), *names).alias(mark))), key, "left")
    few = marked.where(f"{mark} IS NOT NULL").select(*rows.columns, *(F.col(f"{mark}.{c}").alias(c) for c in names))
    rest = marked.where(f"{mark} IS NULL").select(*rows.columns).join(sums.where(~hot).drop("n"), key)
    return few.unionByName(rest.select(*few.columns))


#: Rows that a Python worker is handed at once: its memory follows this, not the table.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on rows in an Arrow batch. It stays lowered, as plans read it when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
