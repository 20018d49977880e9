"""Secret scans by an incremental blob ledger.

Every version of every path is content-addressed: its blob is the SHA-256 of its
text. The ledger keeps which paths held which blob (paths), and for each blob which
rule versions have scanned it and what they found (scans). A run scans only blob
and rule-version pairs that the ledger lacks, appends them and its paths, and joins
the findings of its blobs back to every path that ever held them, in this run or an
earlier one. Copies are so scanned once, and a changed rule rescans only itself.

Defined results: null text is the empty text; a null path is kept and joined by
its blob like any other; rows that repeat path and text get equal findings; an
empty table gives no rows and an empty ledger; further columns of the input are
ignored, so their names cannot clash. Texts are always scanned whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _hot, _store


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int
    #: Finds the same places as the above do, with the least length in the pattern.
    tight: str = ""

    @property
    def search(self) -> str:
        return self.tight or self.pattern

    @property
    def version(self) -> str:
        told = f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}"
        return f"{self.kind}@{hashlib.sha256(told.encode()).hexdigest()[:12]}"


# The base rules of the result contract. Letters of the names are
# written as classes, because engines differ in what ignoring case means.
BASE_RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    # A match takes its run of characters whole and may begin anywhere in it, so only the length decides.
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"(?<![0-9a-f])[0-9a-f]{24,}+"),
)
# Public credential formats beyond the base rules.
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE_RULES + EXTRA_RULES

_BLOCK = 256
_SPANS = "array<struct<start:bigint,ord:int,end:bigint>>"


def _found(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule: the gaps and the matches alternate, so a running sum of their lengths gives places."""
    lengths = F.zip_with(
        F.split(text, rule.search, -1),
        F.regexp_extract_all(text, F.lit(rule.search), F.lit(0)),
        lambda gap, match: F.struct(
            F.length(gap).cast("bigint").alias("gap"), F.length(match).cast("bigint").alias("match")
        ),
    )
    if rule.group:
        lengths = F.zip_with(
            lengths,
            F.regexp_extract_all(text, F.lit(rule.search), F.lit(rule.group)),
            lambda x, part: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), F.length(part).alias("part")),
        )
    kept = "part" if rule.group else "match"
    width = lambda x: x["gap"] + F.coalesce(x["match"], F.lit(0).cast("bigint"))

    def within(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("at"), F.array().cast(_SPANS).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + width(x)).alias("at"),
                F.when(
                    x[kept] >= rule.least,
                    F.array_append(
                        acc["out"],
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            F.lit(order).alias("ord"),
                            (acc["at"] + width(x)).alias("end"),
                        ),
                    ),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
            lambda acc: acc["out"],
        )

    # Appending copies an array: in blocks, a text with many matches costs little
    # more than their number. An array of one and transform() name a value.
    named = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    cut = named(
        lengths,
        lambda all_: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _BLOCK).cast("int")),
            lambda k: F.slice(all_, k * _BLOCK + 1, F.lit(_BLOCK)),
        ),
    )
    zero = F.lit(0).cast("bigint")
    starts = lambda blocks: F.aggregate(
        F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + width(x))),
        F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        lambda acc: acc["out"],
    )
    spans = named(cut, lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), within)))
    return F.when(text.rlike(rule.search), spans).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat(
                F.element_at(names, x["ord"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")
            ),
        ),
        ",",
    )


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan all versions; return path, blob, spans (array of start, ord, end by place).

    One row per input row, and one for each other path that an earlier run recorded
    for a blob of this one. `ledger` is a folder all executors share; it may hold
    earlier runs. `ord` is the 1-based place of the span's rule in `rules`.
    """
    spark = versions.sparkSession
    scans, held = f"{ledger}/scans", f"{ledger}/paths"
    texts = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "blob", F.unhex(F.sha2("text", 256))
    )
    paths = _store.materialise(texts.select("path", "blob"), "paths")
    blobs = _store.materialise(paths.groupBy("blob").agg(F.min("path").alias("of"), F.count("*").alias("n")), "blobs")
    every = F.array(*[F.lit(r.version) for r in rules])
    if _store.exists(spark, scans):
        seen = spark.read.parquet(scans).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn(
            "unseen", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        )
    else:
        todo = blobs.withColumn("unseen", every)
    todo = todo.filter(F.size("unseen") > 0).select(
        F.col("blob").alias("todo_blob"), F.col("of").alias("todo_of"), "unseen"
    )
    # One of a blob's paths lends its text. Dealt by path and blob, copies do not
    # meet in one task; the hash join keeps the small side, so texts are not sorted.
    lent = texts.join(
        todo.hint("shuffle_hash"),
        F.col("path").eqNullSafe(F.col("todo_of")) & (F.col("blob") == F.col("todo_blob")),
    )
    found = F.concat(
        *[
            F.when(F.array_contains("unseen", r.version), _found(F.col("text"), r, i)).otherwise(F.array().cast(_SPANS))
            for i, r in enumerate(rules, 1)
        ]
    )
    # Most texts have no place of any rule, which one look tells.
    hit = F.col("text").rlike("|".join(f"(?:{r.search})" for r in rules))
    lent.select(
        "blob",
        F.col("unseen").alias("rules"),
        F.transform(
            F.when(hit, found).otherwise(F.array().cast(_SPANS)),
            lambda x: F.struct(
                F.element_at(every, x["ord"]).alias("rule"), x["start"].alias("start"), x["end"].alias("end")
            ),
        ).alias("spans"),
    ).write.mode("append").parquet(scans)
    same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob"))
    versions_now = paths.distinct()
    if _store.exists(spark, held):
        earlier = spark.read.schema(paths.schema).parquet(held)
        told = earlier.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"))
        fresh = _store.materialise(versions_now.join(told, same, "left_anti"), "fresh")
        mine = versions_now.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"))
        others = earlier.join(blobs.select("blob"), "blob", "left_semi").join(mine, same, "left_anti")
        every_path = _store.materialise(paths.unionByName(others), "paths")
        blobs = every_path.groupBy("blob").agg(F.count("*").alias("n"))
    else:
        fresh, every_path = versions_now, paths
    fresh.write.mode("append").parquet(held)
    findings = (
        spark.read.parquet(scans)
        .filter(F.size("spans") > 0)
        .join(blobs.select("blob"), "blob", "left_semi")
        .select("blob", F.explode("spans").alias("span"))
        .withColumn("ord", F.array_position(every, F.col("span.rule")).cast("int"))
        .filter("ord > 0")
        .groupBy("blob")
        .agg(
            F.array_sort(
                F.collect_set(
                    F.struct(F.col("span.start").alias("start"), "ord", F.col("span.end").alias("end"))
                )
            ).alias("spans")
        )
    )
    return _hot.salted(every_path, findings, "blob", blobs, "n", every_path.count(), by="path").select(
        "path", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")
    )


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """Counts and digests of scan()'s spans; the first three rules are the base ones."""
    kinds = [r.kind for r in rules]
    count = lambda i: F.size(F.filter("spans", lambda x: x["ord"] == i)).cast("bigint")
    base = F.filter("spans", lambda x: x["ord"] <= len(BASE_RULES))
    return found.select(
        F.col("path").alias(path),
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES, 1)],
        F.sha2(_joined(base, kinds), 256).alias("base_sha256"),
        _joined(F.col("spans"), kinds).alias("spans"),
    )


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every text of documents, by a ledger of this run's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(scan(docs, _store.fresh_path(spark, "ledger")))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, r, {i} AS ord, '{x.kind}' AS kind, regexp_split_to_array(t, {quoted(x.pattern)}) AS gaps, "
        f"regexp_extract_all(t, {quoted(x.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(x.pattern)}, {x.group}) AS g, {x.least} AS least FROM base"
        for i, x in enumerate(RULES, 1)
    )
    return f"""
WITH base AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
e AS (SELECT doc_id, r, ord, kind, length(m[i]) AS n, length(g[i]) AS kept, least,
        list_sum(list_transform(gaps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
f AS (SELECT r, ord, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS span FROM e WHERE kept >= least),
a AS (SELECT r, count(*) FILTER (ord = 1) AS n_assign, count(*) FILTER (ord = 2) AS n_access, count(*) FILTER (ord = 3) AS n_hex,
        coalesce(string_agg(span, ',' ORDER BY s, ord) FILTER (ord <= 3), '') AS b, string_agg(span, ',' ORDER BY s, ord) AS spans
      FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM base LEFT JOIN a USING (r)
"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES = {"op1_secret_scan": _oracle()}
