"""Row numbers within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Add the 0-based rank of each row in its group, as column `out`.

    `bucket` cuts a group into consecutive pieces: it must never decrease along
    `order`. Rows are numbered inside (group, bucket), and a running sum over
    the pieces' counts, one row each, gives where a piece starts. A group with a
    third of all rows is so spread over as many tasks as it has buckets.

    Group and bucket are one struct column, in which nulls are equal: rows are
    dealt once, for numbering and for meeting their piece's start.
    """
    pieces = df.withColumn("_piece_key", F.struct(*group, bucket.alias("_bucket")))
    within = Window.partitionBy("_piece_key").orderBy(*order)
    of_group = [F.col(f"_piece_key.{g}") for g in group]
    before = Window.partitionBy(*of_group).orderBy("_piece_key._bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        pieces.groupBy("_piece_key")
        .agg(F.count("*").alias("_n"))
        .select("_piece_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        pieces.withColumn("_in_piece", F.row_number().over(within) - 1)
        .join(starts, "_piece_key")
        .withColumn(out, F.col("_start") + F.col("_in_piece"))
        .drop("_piece_key", "_in_piece", "_start")
    )
