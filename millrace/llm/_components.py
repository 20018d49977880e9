"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _store


def _largest(links: DataFrame) -> DataFrame:
    """Each node sends its greater neighbours to the least node around it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smallest(links: DataFrame) -> DataFrame:
    """Each node sends its lesser neighbours and itself to the least of them. Links lead from greater to lesser."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """Per node that has a link: node, root (the least node of its component).

    links has columns a and b. Nodes are compared by their order, null links and
    links of a node to itself are ignored. Every round is written to the shared
    folder, so lineage stays short and lost executors cost one round at most.
    The number of rounds grows with the logarithm of the longest chain.
    """
    now = _store.materialise(links.filter("a != b").select("a", "b").distinct(), label)
    sign = None
    while True:
        now = _store.materialise(_smallest(_largest(now)), label)
        told = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if (told["n"], told["sum"]) == sign:
            break
        sign = (told["n"], told["sum"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
