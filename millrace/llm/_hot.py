"""Looking up rows by a key of which a third of all rows may be one.

A key is hot if more than limit(total) of the total rows have it. There are so
at most MOST of them, whatever the size of the tables: they can be broadcast, and
only rows of the other keys, each of few rows, are dealt by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 20_000


def limit(total: int) -> int:
    return max(64, total // MOST)


def looked_up(rows: DataFrame, found: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Rows that have their key in found, with its columns.

    found has one row per key, never null, and in column n how many rows have it,
    of `total` in all; n is left out.
    """
    hot = F.broadcast(found.filter(F.col(n) > limit(total)).drop(n))  # MOST rows at most
    cold = found.filter(F.col(n) <= limit(total)).drop(n)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def salted(rows: DataFrame, found: DataFrame, key: str, counts: DataFrame, n: str, total: int, by: str, salts: int = 64) -> DataFrame:
    """All rows, with the columns of found where it has their key: for rows of found too large to broadcast.

    Rows of hot keys are dealt in as many parts as there are salts, by column `by`; what
    found has of them meets each part. counts: key, and n, how many rows have it.
    """
    hot = F.broadcast(counts.filter(F.col(n) > limit(total)).select(key, F.lit(True).alias("_hot")))  # MOST rows at most
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0)
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, key, "left").withColumn("_salt", part).drop("_hot")
    right = found.join(hot, key, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return left.join(right, [key, "_salt"], "left").drop("_salt")
