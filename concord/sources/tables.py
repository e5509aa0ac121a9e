"""Table sinks: partitioned summaries, schema-filtered appends, merges, and rewrites of the folders that changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import shared_dir

#: Folders of a table that is changed by key.
BUCKETS = 64


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder no run used before, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows reads it as often as it likes, and after a lost executor too."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> DataFrame:
    """Write one folder per value of ``by`` and read the table back."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def for_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the columns the target table has; fields it lacks are dropped, not an error."""
    return df.select(*[c for c in df.columns if c in set(columns)])


def append_events(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    for_schema(df, columns).write.mode("append").parquet(path)


def upsert(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], update: dict[str, Column], insert: dict[str, Column]
) -> DataFrame:
    """New state of ``target`` after a merge on ``keys``.

    ``update`` and ``insert`` map a target column to an expression over ``t`` (the old row)
    and ``s`` (the change); a target column in neither keeps its old value. The result is a
    plan over the old table: write it to a new folder and switch readers over, never onto
    the folder it reads.
    """
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), changes.withColumn("_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = t.join(s, on, "full_outer" if insert else "left")
    both, new = F.col("t._t") & F.col("s._s"), F.col("t._t").isNull()
    cols = []
    for name in target.columns:
        value = F.col(f"t.{name}")
        if insert:
            value = F.when(new, insert[name]).otherwise(value) if name in insert else value
        if name in update:
            value = F.when(both, update[name]).otherwise(value)
        cols.append(value.alias(name))
    return joined.select(*cols)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The folder of a row; equal keys share one, nulls included."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def bucketed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` with its column ``bucket``, or None before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def rewrite_buckets(
    path: str, changes: DataFrame, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS,
    columns: Sequence[str] | None = None,
) -> None:
    """Replace the rows of the folders that ``changes`` touch by ``merge(old rows of these folders, changes)``.

    A table is kept in a fixed number of folders by a hash of its keys; the others are neither read nor written. ``merge``
    must keep keys where they are and leave none of its old keys out. New files take the place of old ones when the job
    commits; a job that fails before leaves the table as it was. Running the same changes again must give
    the same rows, which upserts and newest-row merges do. At most ``buckets`` numbers reach the driver.
    """
    touched = sorted(r.bucket for r in changes.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect())
    if not touched:
        return
    table, kept = bucketed(changes.sparkSession, path), list(columns or changes.columns)
    old = table.where(F.col("bucket").isin(touched)).select(*kept) if table is not None else changes.select(*kept).limit(0)
    new = merge(old, changes).withColumn("bucket", bucket_of(keys, buckets))
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_table(
    path: str, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], update: dict[str, Column], insert: dict[str, Column],
    buckets: int = BUCKETS,
) -> None:
    """:func:`upsert` of the table at ``path``, rewriting only the folders of changed keys. ``columns`` are the table's.

    ``changes`` must hold all of them and may hold more; ``s`` and ``t`` are as there.
    """
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert(old.select(*columns), new, keys, update, insert).select(*columns)

    rewrite_buckets(path, changes, keys, merge, buckets, columns)


def update_where(target: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    """New state of ``target`` with ``values`` set on the rows that meet the predicate."""
    hit = F.coalesce(predicate, F.lit(False))
    return target.select(
        *[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns]
    )
