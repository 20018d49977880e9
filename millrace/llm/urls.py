"""URL filters: host word segmentation and multinomial naive Bayes.

Rules come first: a rule is a host and a path prefix; it fits that host and all
its subdomains, and the longest fitting rule wins. Where no rule fits, a
unigram Viterbi splits the concatenated names of the host's labels and of the
path into words, and a multinomial naive Bayes over the words of both decides.

The unigram model and the classifier are trained here, from a seed list of
labelled URLs and from word counts over all given URLs: alphabetic runs that a
separator bounds on both sides are known words. The lexicon has every word seen
`least` times or more, however many. It is a table in the shared folder and never
at one place: each distinct run of letters meets those words of it that stand in
the run, and is split by them once. Only words of at most SHORT letters, which the
alphabet bounds, are held everywhere, as they stand in very many runs. Pages are
dealt in blocks, so a run that most URLs have meets each block once.

Defined results: a null url, or one without ://, has an empty host and path, no
rule, and is judged by the classifier's prior; a null page_id passes through;
repeated rows get equal results; an empty table gives no rows; other columns
are ignored, so their names cannot clash. URLs of any length are judged whole.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _store

#: Words of so many letters: at most 26 + 26^2 + 26^3.
SHORT = 3
BLOCK_PAGES = 2048

@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the result contract.
RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)

#: Labelled seeds: whole URLs, as an editor would note them.
SEEDS = tuple(
    [(f"http://{x}/", "block") for x in (
        "casino-win.com/bonus", "free-casino.com/slots/jackpot", "poker-bonus.net/play/win", "online-poker.com/bet",
        "bet-win.com/odds/bonus", "lucky-slots.com/spin/casino", "adult-video.com/porn", "free-porn.net/xxx/video",
        "xxx-cams.com/adult/live", "hot-sex.net/adult/dating", "cheap-pills.com/viagra/buy", "viagra-shop.net/pills/order",
        "cialis-online.com/cheap/pills", "payday-loan.com/cash/fast", "quick-cash.net/loan/apply", "crypto-double.com/win/bonus",
        "free-download.net/crack/keygen", "warez-crack.com/serial/keygen", "torrent-movies.net/free/download", "replica-watch.com/cheap/buy",
        "win-prize.com/claim/free", "hack-account.net/password/crack", "escort-girls.com/adult/sex", "spam-mail.com/bulk/cheap",
    )]
    + [(f"http://{x}/", "allow") for x in (
        "news.com/world/story", "blog.com/post/travel", "wiki.org/article/history", "university.edu/research/paper",
        "library.org/book/catalog", "museum.org/collection/science", "weather.com/forecast/city", "school.edu/class/lesson",
        "docs.com/guide/install", "forum.com/topic/answer", "health.gov/guide/advice", "city.gov/service/form",
        "recipe.com/kitchen/bread", "garden.com/plant/guide", "music.com/album/review", "film.com/review/drama",
        "sport.com/match/report", "science.org/journal/article", "code.com/project/source", "shop.com/product/shirt",
        "bank.com/account/help", "travel.com/hotel/city", "photo.com/gallery/nature", "map.com/route/street",
    )]
)

_RUN = re.compile(r"[a-z]+")


def host_of(url: Column) -> Column:
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[UrlRule] = RULES) -> Column:
    """Struct of name and verdict of the longest fitting rule, or null; equal lengths: the first in order of name."""
    found = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: (-len(r.name), r.name))
    ]
    return F.coalesce(*found)


def runs(url: str) -> list[str]:
    """Alphabetic runs of a URL's host, without its last label, and of its path."""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return _RUN.findall(host.lower().rpartition(".")[0]) + _RUN.findall(path.lower())


class Segmenter:
    """Splits a run of letters into its likeliest words by unigram Viterbi.

    A word of the lexicon costs minus the logarithm of its share. Any other
    word costs as an unknown one, and more for each letter: Laplace smoothing
    over a uniform spelling of 26 letters. `words` may be those words only that
    stand in the runs to split, if the `total` of the whole lexicon is given.
    """

    def __init__(self, words: dict[str, int], total: int | None = None):
        self.total = total or sum(words.values()) + 1
        self.cost = {w: -math.log(n / self.total) for w, n in words.items()}
        self.longest = max((len(w) for w in words), default=1)
        self.split = lru_cache(1 << 16)(self._split)

    def unknown(self, length: int) -> float:
        return math.log(self.total) + length * math.log(26)

    def _split(self, run: str) -> tuple[str, ...]:
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        # opened[i]: the cheapest cost at which an unknown word that covers letter i began, and where.
        opened, since = math.inf, 0
        for end in range(1, n + 1):
            if best[end - 1] + math.log(self.total) < opened:
                opened, since = best[end - 1] + math.log(self.total), end - 1
            opened += math.log(26)
            best[end], back[end] = opened, since
            for start in range(max(0, end - self.longest), end):
                cost = self.cost.get(run[start:end])
                if cost is not None and best[start] + cost <= best[end]:
                    best[end], back[end] = best[start] + cost, start
        out = []
        while n:
            out.append(run[back[n] : n])
            n = back[n]
        return tuple(reversed(out))


class Bayes:
    """Multinomial naive Bayes of words, with one added to every count; words it never saw say nothing."""

    def __init__(self, examples: Iterable[tuple[list[str], str]]):
        self.words = {"allow": Counter(), "block": Counter()}
        self.urls: Counter = Counter()
        for words, verdict in examples:
            self.words[verdict].update(words)
            self.urls[verdict] += 1
        known = set().union(*self.words.values())
        total = {v: sum(c.values()) + len(known) for v, c in self.words.items()}
        self.weight = {
            w: math.log((self.words["block"][w] + 1) / total["block"]) - math.log((self.words["allow"][w] + 1) / total["allow"])
            for w in known
        }
        self.prior = math.log((self.urls["block"] + 1) / (self.urls["allow"] + 1))

    def score(self, words: Iterable[str]) -> float:
        """Log odds of block."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in words)


def counts(pages: DataFrame, least: int = 3) -> DataFrame:
    """word and n: words of the seeds, and all runs of all URLs that stand `least` times or more."""
    spread = pages.select(
        F.explode(
            F.regexp_extract_all(
                F.concat_ws("/", F.regexp_replace(host_of(F.col("url")), r"[^.]*$", ""), F.lower(path_of(F.col("url")))),
                F.lit("[a-z]+"),
                F.lit(0),
            )
        ).alias("word")
    )
    common = spread.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    seeds: Counter = Counter()
    for url, _ in SEEDS:
        seeds.update({w: least for w in runs(url)})
    told = json.dumps([{"word": w, "n": n} for w, n in seeds.items()])
    seeded = pages.sparkSession.range(1).select(F.inline(F.from_json(F.lit(told), "array<struct<word:string,n:bigint>>")))
    return common.unionByName(seeded).groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(pages: DataFrame, least: int = 3) -> dict[str, int]:
    """All of counts() at one place, for small tables; judge() does not use it."""
    return {r["word"]: r["n"] for r in counts(pages, least).collect()}


def within(run: str, lengths: Iterable[int]) -> Iterator[str]:
    """The distinct parts of a run that have one of these lengths."""
    for n in lengths:
        yield from {run[k : k + n] for k in range(len(run) - n + 1)}


def segmented(found: DataFrame, known: DataFrame, short: dict[str, int], lengths: list[int], total: int) -> DataFrame:
    """run and words: each distinct run, split by all words of the lexicon; `known` has its words of over SHORT letters, of these `lengths`."""

    def parts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, size = [], [], 0
        for batch in source:
            for key, run in zip(batch.column("key").to_pylist(), batch.column("run").to_pylist()):
                for word in within(run, lengths):
                    keys.append(key)
                    words.append(word)
                    size += 32 + len(word)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], ["key", "word"])
                        keys, words, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], ["key", "word"])

    def split(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for run, met in zip(batch.column("run").to_pylist(), batch.column("met").to_pylist()):
                words = {w: short[w] for w in within(run, range(1, SHORT + 1)) if w in short}
                words |= {x["word"]: x["n"] for x in met or ()}
                out.append(Segmenter(words, total)._split(run))
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(out, pa.list_(pa.string()))], ["run", "words"])

    runs_once = found.select("run").distinct().withColumn("key", F.md5("run"))
    met = (
        runs_once.mapInArrow(parts, "key string, word string").join(known, "word")
        .groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("met"))
    )
    return runs_once.join(met, "key", "left").select("run", "met").mapInArrow(split, "run string, words array<string>")


def judge(pages: DataFrame, rules: Iterable[UrlRule] = RULES, least: int = 3) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, words (space-joined), score (log odds of block)."""
    place = F.monotonically_increasing_id()
    blocked = _store.materialise(pages.select("page_id", "url", F.floor(place / BLOCK_PAGES).alias("block")), "urls")
    known = _store.materialise(counts(blocked, least), "lexicon")
    size = F.length("word")
    shape = known.agg(F.sum("n").alias("n"), F.collect_set(F.when(size > SHORT, size)).alias("lengths")).first()
    total, lengths = shape["n"] + 1, sorted(shape["lengths"])
    short = {r["word"]: r["n"] for r in known.filter(size <= SHORT).collect()}
    longer = known.filter(size > SHORT)
    sought = {w for url, _ in SEEDS for run in runs(url) for w in within(run, lengths)}
    seeding = Segmenter(short | {r["word"]: r["n"] for r in longer.filter(F.col("word").isin(sorted(sought))).collect()}, total)
    bayes = Bayes(([w for run in runs(url) for w in seeding.split(run)], verdict) for url, verdict in SEEDS)

    def runs_in(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            pairs = {(b, run) for b, url in zip(batch.column("block").to_pylist(), batch.column("url").to_pylist()) for run in runs(url or "")}
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.string())], ["block", "run"]
            )

    def scored(rows: pa.Table, words_of: pa.Table) -> pa.Table:
        split = dict(zip(words_of.column("run").to_pylist(), words_of.column("words").to_pylist()))
        words = [[w for run in runs(url or "") for w in split[run]] for url in rows.column("url").to_pylist()]
        return pa.table(
            [
                *[rows.column(c) for c in ("page_id", "host", "path", "rule", "ruled")],
                pa.array([" ".join(x) for x in words], pa.string()),
                pa.array([bayes.score(x) for x in words], pa.float64()),
            ],
            ["page_id", "host", "path", "rule", "ruled", "words", "score"],
        )

    found = _store.materialise(blocked.select("block", "url").mapInArrow(runs_in, "block bigint, run string").distinct(), "runs")
    split_runs = found.join(segmented(found, longer, short, lengths, total), "run")
    ruled = (
        blocked.select("block", "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
        .select("block", "page_id", "url", "host", "path", F.col("_rule.name").alias("rule"), F.col("_rule.verdict").alias("ruled"))
    )
    kind = dict(pages.dtypes)["page_id"]
    return ruled.groupBy("block").cogroup(split_runs.groupBy("block")).applyInArrow(
        scored, f"page_id {kind}, host string, path string, rule string, ruled string, words string, score double"
    ).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        "words", "score",
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES: dict[str, str] = {}
