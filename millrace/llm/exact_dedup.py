"""Exact dedup by an extendible-hash index on shared files.

An entry is one document: the XXH64 of its normalised text is its key. The
directory is indexed by the leading bits of the key. It starts with one bucket
and is doubled while a bucket has more than `capacity` distinct keys; a bucket
uses as few bits as it can. A bucket is so a range of keys, and is dealt whole to
one owner task, with its texts. There, texts of one key form a chain: each is
compared by its bytes to the one before it in order, and every distinct text gets
its place in the chain, its copies counted and the document of it that stays.
Entries, directory and index are Parquet tables in the shared folder. Documents
look up their class by key, and where a chain has several texts, by key and text.

The directory has as many levels as it takes. From PAGE * MOST_BUCKETS keys on,
buckets hold more keys instead of becoming more. Keys that very many entries
have, of which there is a bounded number, are combined on the way to their owner
and broadcast on the way back, so a text that a third of all rows share meets its
owner once per map task. Buckets hold distinct keys only, so copies never
overfill one.

Defined results: null text is the empty text, and all texts of white space only
are one class; doc_id may be of any type that has an order, and a null one loses
every tie; rows that repeat doc_id and text count in group_size and share one
verdict; an empty table gives no rows; other columns are ignored, so their names
cannot clash. Texts are compared whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import _hot, _store

#: Fixed value: the characters that normalising deletes.
SPACE = r"[\x20\x09-\x0D]+"
#: Distinct keys of a bucket, and how many buckets there may be before they grow.
PAGE = 1024
MOST_BUCKETS = 1 << 18


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("bigint")  # shifting by 64 does nothing


def directory(keys: DataFrame, capacity: int = PAGE) -> tuple[DataFrame, int]:
    """Directory of the distinct `key`s, and its depth.

    One row per slot that has keys: slot (the key's leading bits, as many as the
    depth), local (bits that its bucket uses), bucket (the first slot of its bucket).
    """
    largest, depth = keys.count(), 0
    capacity = max(capacity, -(-largest // MOST_BUCKETS))
    while largest > capacity and depth < 64:
        depth = min(64, depth + math.ceil(math.log2(largest / capacity)))
        largest = keys.groupBy(_leading(F.col("key"), depth).alias("slot")).count().agg(F.max("count")).first()[0]
    slots = keys.groupBy(_leading(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n"))
    levels = slots.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.withColumn("prefix", F.when(F.col("level") == 0, 0).otherwise(F.expr(f"shiftrightunsigned(slot, {depth} - level)")))
    fits = levels.groupBy("level", "prefix").agg(F.sum("n").alias("total")).filter(F.col("total") <= capacity).select("level", "prefix")
    first = F.expr(f"CASE WHEN local = 0 THEN 0L ELSE shiftleft(shiftrightunsigned(slot, {depth} - local), {depth} - local) END")
    found = levels.join(fits, ["level", "prefix"]).groupBy("slot").agg(F.min("level").alias("local"))
    return _store.materialise(found.withColumn("bucket", first), "directory"), depth


def counted(keys: DataFrame) -> tuple[DataFrame, int]:
    """Distinct `key`s and how many entries (copies) have them; all entries."""
    found = _store.materialise(keys.groupBy("key").agg(F.count("*").alias("copies")), "keys")
    return found, found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]


def dealt(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """rows, which have a key, with their bucket."""
    small = slots.count() <= 4 * MOST_BUCKETS
    at = slots.select("slot", "bucket")
    return rows.withColumn("slot", _leading(F.col("key"), depth)).join(F.broadcast(at) if small else at, "slot").drop("slot")


def _combined(rows: DataFrame, keys: DataFrame, total: int, combine) -> DataFrame:
    """rows, those of hot keys passed through `combine`, which gives such rows again but fewer."""
    hot = F.broadcast(keys.filter(F.col("copies") > _hot.limit(total)).select("key"))  # _hot.MOST rows at most
    return rows.join(hot, "key", "left_anti").unionByName(combine(rows.join(hot, "key", "left_semi")))


def _best(text: Column) -> Column:
    """Least for the row that stays: the most code points, then the least doc_id, nulls last."""
    size = F.length(F.coalesce(text, F.lit(""))).cast("bigint")
    return F.struct((-size).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))


def index(entries: DataFrame, keys: DataFrame, total: int, slots: DataFrame, depth: int) -> DataFrame:
    """One row per distinct text: bucket, key, chain (place in its key's chain, from 1), texts (of the chain), sha, keep_id, group_size, norm.

    norm is null where the chain has one text, which its key then tells. entries:
    key, norm, best.
    """

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", "key", "norm").agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))

    rows = dealt(entries.select("key", "norm", "best", F.lit(1).cast("bigint").alias("copies")), slots, depth)
    owned = combine(_combined(rows, keys, total, combine).repartition("bucket"))  # in the owner task: no shuffle of its own
    chain = Window.partitionBy("bucket", "key")
    found = owned.select(
        "bucket", "key", F.row_number().over(chain.orderBy("norm")).alias("chain"), F.count("*").over(chain).alias("texts"),
        F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("best.id").alias("keep_id"), F.col("copies").alias("group_size"), "norm",
    )
    return found.withColumn("norm", F.when(F.col("texts") > 1, F.col("norm")))


def classes(docs: DataFrame, capacity: int = PAGE) -> DataFrame:
    """Per document: doc_id, key, chain, sha, keep_id, group_size, kept."""
    norm = docs.select("doc_id", _best(F.col("text")).alias("best"), normalised(F.col("text")).alias("norm"))
    entries = _store.materialise(norm.select("doc_id", F.xxhash64("norm").alias("key"), "best", "norm"), "entries")
    keys, total = counted(entries.select("key"))
    slots, depth = directory(keys, capacity)
    texts = _store.materialise(index(entries, keys, total, slots, depth), "index")
    told = ["key", "chain", "sha", "keep_id", "group_size"]
    alone = texts.filter("texts = 1").select(*told, F.col("group_size").alias("n"))
    out = _hot.looked_up(entries.select("doc_id", "key"), alone, "key", "n", total)
    several = texts.filter("texts > 1").select(*told, "norm")
    if not several.isEmpty():  # texts that share a key
        out = out.unionByName(entries.select("doc_id", "key", "norm").join(several, ["key", "norm"]).drop("norm"))
    return out.select("doc_id", *told, F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduplicated(docs: DataFrame, capacity: int = PAGE) -> DataFrame:
    """docs with one row of each class, the one that classes() keeps, with all its columns.

    Rows go to the owners of their buckets whole, and those that stay come from
    there: texts are shuffled once. Of rows that repeat doc_id and text, one stays.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(normalised(F.col("text"))).alias("key")
    )
    keys, total = counted(rows.select("key"))
    slots, depth = directory(keys, capacity)

    def combine(given: DataFrame) -> DataFrame:
        each = given.withColumns({"doc_id": F.col("_row.doc_id"), "norm": normalised(F.col("_row.text"))})
        order = F.struct(_best(F.col("_row.text")), F.xxhash64("_row.text"))
        return each.groupBy("bucket", "key", "norm").agg(F.min_by("_row", order).alias("_row")).select("bucket", "key", "_row")

    return combine(_combined(dealt(rows, slots, depth), keys, total, combine).repartition("bucket")).select("_row.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select(
        "doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
}
