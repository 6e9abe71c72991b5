"""Pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one bucket of a running sum holds on average.
BUCKET_ROWS = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded(table: DataFrame, rows: int) -> DataFrame:
    """``table`` marked for broadcast if it has at most ``rows`` rows, else as it is; for written tables, which are cheap to count."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def words_of(text: str | Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+")
    n = F.size(parts)
    # a separator at either end leaves one empty part there; an empty text is one empty part
    ends = F.when(parts[0] == "", 1).otherwise(0) + F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (n - ends).cast("long")


def running_offset(df: DataFrame, group: list[str], weight: str, order: list[str], rows: int, out: str = "offset") -> DataFrame:
    """Add the sum of ``weight`` over the rows of the group that come before.

    The order is a hash of ``order``, then its columns: a fixed shuffle. No
    group is ever gathered: rows fall into hash buckets of about
    ``BUCKET_ROWS``, buckets get offsets from their sums, and only a bucket
    is sorted in one task. Rows equal in all of ``order`` may swap places.
    """
    n = 1 << max(0, (max(1, rows) // BUCKET_ROWS).bit_length())
    h = F.xxhash64(F.lit(20260101), *order)
    df = df.withColumn("__ro_h", h).withColumn("__ro_b", F.pmod(F.shiftright("__ro_h", 20), F.lit(n)).cast("int"))
    sums = df.groupBy(*group, "__ro_b").agg(F.sum(weight).alias("__ro_w"))
    before = Window.partitionBy(*group).orderBy("__ro_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__ro_base", F.coalesce(F.sum("__ro_w").over(before), F.lit(0)).cast("long")).drop("__ro_w")
    keys = [*group, "__ro_b"]
    right = sums.select(*[F.col(k).alias(f"__ro_r{i}") for i, k in enumerate(keys)], "__ro_base")
    on = [F.col(k).eqNullSafe(F.col(f"__ro_r{i}")) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    inside = Window.partitionBy(*keys).orderBy("__ro_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(right, cond)
        .drop(*[f"__ro_r{i}" for i in range(len(keys))])
        .withColumn(out, F.col("__ro_base") + F.coalesce(F.sum(weight).over(inside), F.lit(0)).cast("long"))
        .drop("__ro_h", "__ro_b", "__ro_base")
    )
