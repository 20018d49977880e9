"""Progress of a run: rates between samples, time to go, goal, and a listener."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

GIB = 1073741824


def rates(samples: DataFrame, goals: tuple[float, ...] = (1.0, 3.0), by: tuple[str, ...] = ()) -> DataFrame:
    """Add docs_min and mb_h between samples (t in seconds, docs, bytes), 0 at the first, and goal and eta_h.

    The goal is the first not yet reached; hours to it are told from 1 MB an hour on.
    """
    order = Window.partitionBy(*by).orderBy("t")
    dt = F.col("t") - F.lag("t").over(order)
    per = lambda c, k: F.coalesce(F.try_divide((F.col(c) - F.lag(c).over(order)) * F.lit(float(k)), dt), F.lit(0.0))
    goal = F.lit(None).cast("double")
    for g in sorted(goals, reverse=True):
        goal = F.when(F.col("bytes") < g * GIB, F.lit(float(g))).otherwise(goal)
    return (
        samples.withColumn("docs_min", per("docs", 60))
        .withColumn("mb_h", per("bytes", 3600) / F.lit(1048576.0))
        .withColumn("goal", goal)
        .withColumn("eta_h", F.when(F.col("mb_h") > 1, (F.col("goal") * GIB - F.col("bytes")) / F.lit(1048576.0) / F.col("mb_h")))
    )


def until_goal(rows: DataFrame, size: str, goal_bytes: int, stored: int = 0, order: str = "seq", pieces: int = 256) -> DataFrame:
    """Rows before which less than goal_bytes was stored; a goal of 0 keeps all.

    The running total is taken within ranges of `order` and carried across them,
    so no task sees all rows.
    """
    if not goal_bytes:
        return rows
    piece = F.pmod(F.floor(F.col(order) / pieces), F.lit(1 << 40))
    cut = rows.withColumn("_piece", piece)
    within = Window.partitionBy("_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_piece").agg(F.sum(size).alias("_s")).select(
        F.col("_piece").alias("_p"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carried")
    )
    return (
        cut.withColumn("_here", F.coalesce(F.sum(size).over(within), F.lit(0)))
        .join(sums, F.col("_piece") == F.col("_p"))
        .filter(F.col("_carried") + F.col("_here") + stored < goal_bytes)
        .drop("_piece", "_p", "_here", "_carried")
    )


class ProgressLine(StreamingQueryListener):
    """Tells a line of rows in, rate and batch whenever a streaming query has progressed."""

    def __init__(self, tell: Callable[[str], None] = print):
        self.tell = tell

    def onQueryStarted(self, event):
        self.tell(f"inicio {event.id}")

    def onQueryProgress(self, event):
        p = event.progress
        self.tell(f"lote {p.batchId}: {p.numInputRows} filas, {p.processedRowsPerSecond:.1f} filas/s")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tell(f"fin {event.id} {event.exception or ''}".rstrip())
