"""Tables in the folder that driver and executors share, and row numbers made through them.

Such tables outlive the query that made them, as its result may still be read from them. `scratch` takes away those that
were made inside it, for callers that write the result themselves.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that broadcast_if_small() sends to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: And of bytes, where rows have no bounded width.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="echotrace-"))
    return sc.getCheckpointDir().rstrip("/")


#: Folders made inside of each scratch() that is open.
_OPEN: list[list[str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    folder = f"{shared_dir(spark)}/echotrace-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(folder)
    return f"{folder}/{tag}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Gives a file or folder another name in the same file system; folders above it are made."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(new.getParent())
    if not system.rename(old, new):
        raise OSError(f"{source} can't be moved to {target}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were made inside when it ends; what is needed later has to be written elsewhere before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for folder in _OPEN.pop():
            remove(spark, folder)


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder (or path) and reads it back: cuts the lineage, and a lost executor loses nothing."""
    path = path or new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """A broadcast hint if df, which should be stored, has at most `rows` rows; df itself otherwise.

    Rows must be of bounded width, or weight must give their bytes, which may then be BROADCAST_BYTES in all.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    if weight is not None and (df.agg(F.sum(weight)).first()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def global_row_number(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """df, stored, with a gapless row number from 0 in the given order, and its number of rows.

    A range sort, then the counts of the range partitions give each its first number: no single task sees all rows.
    Equal keys are told apart by their place in the input, so that one frequent key doesn't land in one task.
    """
    keys = [F.col(f"_rows_key{i}") for i in range(len(order))] + [F.col("_rows_place")]
    df = df.select("*", *(c.alias(f"_rows_key{i}") for i, c in enumerate(order)), F.monotonically_increasing_id().alias("_rows_place"))
    df = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_rows_at", F.monotonically_increasing_id()).drop(
        *(f"_rows_key{i}" for i in range(len(order))), "_rows_place"
    )
    df = stored(df, "numbered").withColumn("_rows_part", F.shiftright("_rows_at", 33))
    parts = sorted((r[0], r[1]) for r in df.groupBy("_rows_part").count().collect())  # one row for each partition
    firsts, total = [], 0
    for part, n in parts:
        firsts.append((part, total))
        total += n
    first = df.sparkSession.createDataFrame(firsts, "_rows_part long, _rows_first long")
    out = df.join(F.broadcast(first), "_rows_part").withColumn(name, F.col("_rows_first") + F.col("_rows_at").bitwiseAND((1 << 33) - 1))
    return out.drop("_rows_at", "_rows_part", "_rows_first"), total
