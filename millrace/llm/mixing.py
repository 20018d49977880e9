"""Mixing sources to target weights by Pfair scheduling.

A lane is a source with a target weight; sources without one share the lane of
the rest. A lane's documents, shuffled by a hash of doc_id, are cut into blocks
of `block_docs`. With weight w, block i (from 0) is released at slot floor(i/w)
and due by slot ceil((i+1)/w). Each slot takes the released block with the
earliest deadline, which puts every block inside its window: in any prefix of
the mix a lane deviates from its target by less than one block.

Weights are shares of a whole number of slots, the period. After each period
every lane has exactly its target, so the order of one period, found by
earliest deadline first on as many steps as the period has slots, repeats for
ever: where a document goes is then arithmetic on its rank in its lane.

A lane without any document takes no part: the shares of the others make up the
period, so each keeps its proportion to the others from the first slot to the
last on target.

Lanes run out. The mix is on target until the first lane does; from there its
slots are skipped and the other lanes go on in order, so no document is dropped
or repeated, and `on_target` tells the two parts apart.

Defined results: null and unlisted sources are in the lane of the rest; a null
doc_id is hashed as the empty string; rows with equal doc_id are ordered by
n_chars, and equal rows are interchangeable; an empty table gives no rows;
further columns pass through, but for mix() those of the names that it adds,
which it replaces; mixed() keeps them all.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _ranks

REST = "(rest)"
#: The production mix, in hundredths: the largest source held at a tenth.
TARGET = {"src0": 10} | {f"src{i}": 5 for i in range(1, 10)} | {f"src{i}": 4 for i in range(10, 20)} | {REST: 5}
BLOCK_DOCS = 16
ADDED = ("lane", "lane_rank", "block", "release", "deadline", "slot", "position", "on_target")


def window(block: int, share: int, period: int) -> tuple[int, int]:
    """Release and deadline of a block of a lane with `share` slots in `period`."""
    return block * period // share, -(-(block + 1) * period // share)


def schedule(shares: dict[str, int]) -> list[tuple[str, int]]:
    """One period: for each slot the lane and its block there. Takes as many steps as there are slots."""
    period = sum(shares.values())
    coming = [(0, lane, 0) for lane in sorted(shares)]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            _, lane, block = heapq.heappop(coming)
            heapq.heappush(ready, (window(block, shares[lane], period)[1], lane, block))
        deadline, lane, block = heapq.heappop(ready)
        assert deadline > slot, "a deadline is missed"
        out.append((lane, block))
        if block + 1 < shares[lane]:
            heapq.heappush(coming, (window(block + 1, shares[lane], period)[0], lane, block + 1))
    return out


def placed(docs: DataFrame, shares: dict[str, int] = TARGET, block_docs: int = BLOCK_DOCS, bucket_rows: int = 20_000) -> DataFrame:
    """Column _row, a struct of each row of docs, and ADDED; `position` is the place in the mix, from 0.

    `shares` must hold whole numbers over 0; its sum, the period, and its lanes
    bound what the driver plans. doc_id, source and n_chars are read. Lanes
    without documents are left out of the shares.
    """
    spark = docs.sparkSession
    if REST not in shares:
        shares = shares | {REST: 1}
    named = [x for x in sorted(shares) if x != REST]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "n_chars")
    laned = rows.withColumn(
        "lane", F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(REST))
    ).withColumn("_digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = dict.fromkeys(shares, 0) | {r["lane"]: r["n"] for r in laned.groupBy("lane").agg(F.count("*").alias("n")).collect()}
    if any(sizes.values()):
        shares = {x: share for x, share in shares.items() if sizes[x]}
    period, plan, lanes = sum(shares.values()), schedule(shares), sorted(shares)
    digits = max(1, math.ceil(math.log(max(1, sum(sizes.values()) / bucket_rows), 16)))
    ranked = _ranks.numbered(
        laned,
        ["lane"],
        F.substring("_digest", 1, digits),
        [F.col("_digest"), F.col("doc_id").asc_nulls_last(), F.col("n_chars").asc_nulls_last()],
        "lane_rank",
    )
    place, steps, done = {}, [], dict.fromkeys(lanes, 0)
    for slot, (lane, block) in enumerate(plan):
        place[lane, block] = slot
        steps.append({"lane": lane, "_j": block, "_at": slot, "_before": [done[x] for x in lanes]})
        done[lane] += 1
    # The first slot whose block does not exist or is not full: until there, all are on target.
    full = {x: sizes[x] // block_docs for x in lanes}
    horizon = min(full[x] // shares[x] * period + place[x, full[x] % shares[x]] for x in lanes)
    order = spark.range(1).select(
        F.inline(
            F.from_json(F.lit(json.dumps(steps)), "array<struct<lane:string,_j:bigint,_at:bigint,_before:array<bigint>>>")
        )
    )
    share = F.element_at(F.create_map(*[F.lit(x) for lane in lanes for x in (lane, shares[lane])]), F.col("lane"))
    block = F.col("lane_rank").cast("bigint")
    blocked = (
        ranked.withColumn("block", F.expr(f"lane_rank div {block_docs}"))
        .withColumn("_share", share.cast("bigint"))
        .withColumn("_round", F.expr("block div _share"))
        .withColumn("_j", F.expr("block % _share"))
        .join(F.broadcast(order), ["lane", "_j"])  # as many rows as the period has slots
    )
    earlier = sum(
        (
            F.least(F.lit(sizes[x]), (F.col("_round") * shares[x] + F.col("_before")[k]) * block_docs)
            for k, x in enumerate(lanes)
        ),
        F.lit(0).cast("bigint"),
    )
    return (
        blocked.withColumn("release", F.expr(f"block * {period} div _share"))
        .withColumn("deadline", F.expr(f"((block + 1) * {period} + _share - 1) div _share"))
        .withColumn("slot", F.col("_round") * period + F.col("_at"))
        .withColumn("position", earlier + block % block_docs)
        .withColumn("on_target", F.col("slot") < horizon)
        .select("_row", *ADDED)
    )


def mix(docs: DataFrame, shares: dict[str, int] = TARGET, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The columns of docs, and those of ADDED."""
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ADDED]
    return placed(docs, shares, block_docs).select(*own, *ADDED)


def mixed(docs: DataFrame, shares: dict[str, int] = TARGET, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows of docs, laid out in the order of the mix: partitions in order, and rows in order within them."""
    return placed(docs, shares, block_docs).repartitionByRange("position").sortWithinPartitions("position").select("_row.*")


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    return mix(docs).drop("n_chars")


def _oracle() -> str:
    """Plans one period by itself, a slot at a time, from the target weights alone."""
    target = ", ".join(f"('{lane}', {share})" for lane, share in TARGET.items())
    named = ", ".join(f"'{x}'" for x in TARGET if x != REST)
    return f"""
WITH RECURSIVE target(lane, share) AS (VALUES {target}),
d AS (SELECT doc_id, source, CASE WHEN source IN ({named}) THEN source ELSE '{REST}' END AS lane,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest, n_chars FROM documents),
w AS (SELECT lane, share, c FROM target JOIN (SELECT lane, count(*) AS c FROM d GROUP BY lane) USING (lane)),
a AS (SELECT list(lane ORDER BY lane) AS lanes, list(share ORDER BY lane) AS shares, CAST(sum(share) AS BIGINT) AS period FROM w),
e(slot, pick, done) AS (
    SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), list_transform(shares, lambda x: CAST(0 AS BIGINT)) FROM a
    UNION ALL
    SELECT slot + 1, p, list_transform(done, lambda n, i: n + CAST(i = p AS BIGINT)) FROM (
        SELECT slot, done, list_min(list_transform(list_filter(range(1, len(done) + 1),
            lambda i: done[i] < shares[i] AND done[i] * period // shares[i] <= slot + 1),
            lambda i: ((done[i] + 1) * period + shares[i] - 1) // shares[i] * 1000 + i)) % 1000 AS p
        FROM e, a WHERE slot + 1 < period)),
p AS (SELECT lanes[pick] AS lane, done[pick] - 1 AS j, slot AS place, shares[pick] AS share FROM e, a WHERE slot >= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY digest, doc_id NULLS LAST, n_chars NULLS LAST) - 1 AS lane_rank FROM d),
t AS (SELECT r.*, lane_rank // {BLOCK_DOCS} AS block, share, lane_rank // {BLOCK_DOCS} // share * period + place AS slot, period
    FROM r JOIN p ON p.lane = r.lane AND p.j = (lane_rank // {BLOCK_DOCS}) % share, a),
h AS (SELECT min(c // {BLOCK_DOCS} // w.share * period + place) AS horizon FROM w JOIN p ON p.lane = w.lane AND p.j = c // {BLOCK_DOCS} % w.share, a)
SELECT doc_id, source, lane, lane_rank, block, CAST(block * period // share AS BIGINT) AS release,
    CAST(((block + 1) * period + share - 1) // share AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot,
    row_number() OVER (ORDER BY slot, lane_rank) - 1 AS position, slot < (SELECT horizon FROM h) AS on_target
FROM t
"""


QUERIES = {"op4_source_mixing": op4_source_mixing}
ORACLES = {"op4_source_mixing": _oracle()}
