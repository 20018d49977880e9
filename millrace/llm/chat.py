r"""Chat formatting with quotation linking.

A message's lines carry a quote level: how many > they begin with. Every line is
normalised (marks off, lower case, one space between words). Consecutive lines of
one level, up to one without words, are a passage: joined by a space, so that it
does not matter where lines are wrapped. Passages, their sentences and their
lines are hashed, of what a message quotes and of what it says itself alike. A
quoted part links to the latest earlier message of its conversation that says it
itself. Where a passage links, its sentences and lines do not count.
A message
replies to the message that its outermost linked quotes come from; of several,
whole passages go before parts of them, and then the latest message; without a linked quote, to the message before it. The
conversation is then given without quotes, each message once, in reply order:
parents come before replies, which the order of turns ensures.

Messages are laid out by ranges of (conversation, turn), so a conversation of
any size is spread over tasks. Numbers and last occurrences are found within
such pieces and carried across them by a table with one row per piece. Quotes
and what they quote are never paired: one pass in order of messages carries the
last place where a line was said.

Defined results: a null conv_id is one conversation of its own, a null turn
comes first, a null role is "unknown", and a null text is empty; messages with
equal turns are ordered by role, then by a hash of the text, and repeated rows
are messages of their own; lines without words link to nothing; an empty table
gives no rows; other columns are ignored, so their names cannot clash. Texts are
read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import _ranks, _store

MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: MARKS with loops that do not take the stack, for lines of very many marks.
_LINEAR_MARKS = r"^[ \t]*+(?:>[ \t]?+)++"
SENTENCE_END = "(?<=[.!?]) "
#: The end of a line that only announces a quote.
ANNOUNCES = r"(?i)\bwrote:[ \t]*$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_substr(line, F.lit(_LINEAR_MARKS)), "[^>]", ""))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, _LINEAR_MARKS, ""), r"\s+", " ")))


def _lines(text: Column) -> Column:
    """Array of structs of each line: level, said (what is normalised), line."""
    return F.transform(
        F.split(text, "\r?\n"),
        lambda x: F.struct(F.coalesce(level(x), F.lit(0)).alias("level"), normalised(x).alias("said"), x.alias("line")),
    )


def passages(text: Column) -> Column:
    """Array of structs of each passage: level, whole (its text), sentences, lines."""
    lines = _lines(text)
    before = F.concat(
        F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("said"), F.lit("").alias("line"))), F.slice(lines, 1, F.size(lines) - 1)
    )
    # Normalised lines have neither line ends nor form feeds.
    marked = F.transform(
        F.arrays_zip(lines.alias("x"), before.alias("y")),
        lambda z: F.when(
            (z["x"]["level"] == z["y"]["level"]) & (z["x"]["said"] != "") & (z["y"]["said"] != ""), F.concat(F.lit("\n"), z["x"]["said"])
        ).otherwise(F.concat(F.lit("\f"), z["x"]["level"].cast("string"), F.lit("\n"), z["x"]["said"])),
    )
    cut = F.transform(F.filter(F.split(F.array_join(marked, ""), "\f"), lambda p: p.rlike("(?s)\n.")), lambda p: F.split(p, "\n", 2))
    return F.transform(
        cut,
        lambda p: F.struct(
            p[0].cast("int").alias("level"),
            F.translate(p[1], "\n", " ").alias("whole"),
            F.split(F.translate(p[1], "\n", " "), SENTENCE_END).alias("sentences"),
            F.split(p[1], "\n").alias("lines"),
        ),
    )


def laid_out(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, position (from 0 in its conversation), piece (never falls with position)."""
    read = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("_hash", F.xxhash64("text"))
    ranged = _store.materialise(
        read.repartitionByRange("conv_id", "turn", "role", "_hash").withColumn("piece", F.spark_partition_id()), "messages"
    )
    return _ranks.numbered(
        ranged, ["conv_id"], F.col("piece"), [F.col("turn").asc_nulls_first(), F.col("role"), F.col("_hash")], "position"
    ).drop("_hash")


def linked(laid: DataFrame) -> DataFrame:
    """Per quoted part that links: conv_id, position, level, passage, kind, n_lines, original (position of the message that said it)."""
    quoting = laid.filter(F.col("text").contains(">"))
    part = lambda kind, n: lambda x: F.struct(F.lit(kind).alias("kind"), n.alias("n_lines"), x.alias("said"))
    # A single line or sentence is its passage.
    several = lambda x: F.when(F.size(x) > 1, x).otherwise(F.array().cast("array<string>"))
    quotes = (
        quoting.select("conv_id", "position", "piece", F.posexplode(passages(F.col("text"))).alias("passage", "x"))
        .filter("x.level > 0")
        .select(
            "conv_id", "position", "piece", F.col("x.level").alias("level"), "passage",
            F.explode(F.concat(
                F.array(part("whole", F.size("x.lines"))(F.col("x.whole"))),
                F.transform(several(F.col("x.sentences")), part("sentence", F.lit(1))),
                F.transform(several(F.col("x.lines")), part("line", F.lit(1))),
            )).alias("u"),
        )
        .select("conv_id", "position", "piece", "level", "passage", "u.kind", "u.n_lines", F.md5("u.said").alias("hash"))
    )
    wanted = quotes.select(F.col("conv_id").alias("_c"), F.col("hash").alias("_h")).distinct()
    talks = quotes.select(F.col("conv_id").alias("_c")).distinct()
    said = (
        laid.join(talks, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
        .select("conv_id", "position", "piece", F.explode(passages(F.col("text"))).alias("x"))
        .filter("x.level = 0")
        .select("conv_id", "position", "piece", F.explode(F.concat(F.array("x.whole"), "x.sentences", "x.lines")).alias("said"))
        .select("conv_id", "position", "piece", F.md5("said").alias("hash"))
        .distinct()
        .join(wanted, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")), "left_semi")
    )
    # A quote comes before what its own message says, so it cannot link to itself.
    order = quotes.withColumn("said_at", F.lit(None).cast("bigint")).unionByName(
        said.withColumn("said_at", F.col("position")), allowMissingColumns=True
    )
    keys = ["conv_id", "hash"]
    pieces = order.groupBy(*keys, "piece").agg(F.max("said_at").alias("latest"))
    earlier = pieces.select(
        *[F.col(k).alias(f"_{k}") for k in (*keys, "piece")],
        F.max("latest").over(Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
    )
    within = (
        Window.partitionBy(*keys, "piece").orderBy("position", F.col("said_at").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("hash") == F.col("_hash")) & (F.col("piece") == F.col("_piece"))
    return (
        order.withColumn("here", F.max("said_at").over(within)).filter("level IS NOT NULL").join(earlier, same)
        .select("conv_id", "position", "level", "passage", "kind", "n_lines", F.coalesce("here", "before").alias("original"))
        .filter("original IS NOT NULL")
    )


def own_words(text: Column) -> Column:
    """The text without quoted lines, and without a line that announces a quote."""
    lines = F.split(text, "\r?\n")
    quoted = lambda x: F.coalesce(x.rlike(_LINEAR_MARKS), F.lit(False))
    after = F.concat(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit("")))
    kept = F.filter(
        F.arrays_zip(lines.alias("line"), after.alias("next")),
        lambda x: ~quoted(x["line"]) & ~(x["line"].rlike(ANNOUNCES) & quoted(x["next"])),
    )
    plain = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), "\n{3,}", "\n\n")
    return F.when(text.contains(">"), F.regexp_replace(plain, r"\A\s++|(?<!\s)\s++\z", "")).otherwise(text)


def conversations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, position, parent, level, n_linked, text without quotes, formatted.

    parent: position of the message it replies to, null for the first; level: of
    the quotes that show it, null if no quote does; n_linked: quoted lines of the
    passages that link, and of other passages the lines, or else the sentences, that
    link by themselves. Rows and positions are by turns, which parents precede in.
    """
    laid = _store.materialise(laid_out(messages), "laid")
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    original = F.col("original")
    by_passage = linked(laid).groupBy("conv_id", "position", "level", "passage").agg(
        F.max(of("whole", original)).alias("whole"),
        F.max(original).alias("latest"),
        F.max(of("whole", F.col("n_lines"))).alias("all"),
        F.count(of("line", original)).alias("lines"),
        F.count(of("sentence", original)).alias("sentences"),
    )
    by_level = by_passage.groupBy("conv_id", "position", "level").agg(
        F.coalesce(F.max("whole"), F.max("latest")).alias("original"),
        F.sum(F.coalesce("all", F.when(F.col("lines") > 0, F.col("lines")).otherwise(F.col("sentences")))).alias("n"),
    )
    found = by_level.groupBy(F.col("conv_id").alias("_c"), F.col("position").alias("_p")).agg(
        F.min(F.struct("level", "original")).alias("first"), F.sum("n").alias("n_linked")
    )
    text = own_words(F.col("text"))
    return laid.join(found, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("position") == F.col("_p")), "left").select(
        "conv_id",
        "turn",
        "role",
        "position",
        F.coalesce("first.original", F.when(F.col("position") > 0, F.col("position") - 1)).alias("parent"),
        F.col("first.level").alias("level"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        text.alias("text"),
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text, F.lit("\n<|end|>\n")).alias("formatted"),
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op9_chat_format": op9_chat_format}
ORACLES = {
    "op9_chat_format": rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), text) - 1 AS position FROM conversations),
l AS (SELECT conv_id, position, unnest(a) AS line, unnest(range(len(a))) AS n FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS a FROM m)),
x AS (SELECT *, CAST(length(regexp_replace(regexp_extract(line, '{MARKS}'), '[^>]', '', 'g')) AS INT) AS level,
    lower(trim(regexp_replace(regexp_replace(line, '{MARKS}', ''), '\s+', ' ', 'g'))) AS said FROM l),
q AS (SELECT conv_id, position, level, (SELECT max(o.position) FROM x o WHERE o.conv_id IS NOT DISTINCT FROM x.conv_id AND o.level = 0
    AND o.said = x.said AND o.position < x.position) AS original FROM x WHERE level > 0 AND said <> ''),
f AS (SELECT conv_id, position, count(*) AS n_linked, min(level) AS level, max(original) FILTER (level = least) AS parent
    FROM (SELECT *, min(level) OVER (PARTITION BY conv_id, position) AS least FROM q WHERE original IS NOT NULL) GROUP BY ALL),
y AS (SELECT *, level > 0 AS quoted, coalesce(lead(level > 0) OVER (PARTITION BY conv_id, position ORDER BY n), false) AS before_quote FROM x),
o AS (SELECT conv_id, position, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT quoted AND NOT (before_quote AND regexp_matches(line, '{ANNOUNCES}'))), '') AS plain
    FROM y GROUP BY ALL),
t AS (SELECT m.*, CASE WHEN contains(text, '>') THEN regexp_replace(regexp_replace(plain, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') ELSE text END AS own
    FROM m JOIN o ON m.conv_id IS NOT DISTINCT FROM o.conv_id AND m.position = o.position)
SELECT t.conv_id, t.turn, t.role, t.position, coalesce(f.parent, CASE WHEN t.position > 0 THEN t.position - 1 END) AS parent, f.level,
    coalesce(n_linked, 0) AS n_linked, own AS text, '<|' || role || '|>' || chr(10) || own || chr(10) || '<|end|>' || chr(10) AS formatted
FROM t LEFT JOIN f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.position = f.position
"""
}
