"""Toxicity by nearest labelled examples.

A text is a TF-IDF vector over all terms of the labelled examples; its nearest
labelled examples by exact cosine vote on it, each with a weight that falls with
its distance. A monotone calibration turns the vote into a probability.

Terms are words and the beginnings of words (inflected and compound forms share
them). A term weighs 1 + log of its count in the text, by its inverse document
frequency in the whole corpus, by the square of its relevance frequency: log2(2 +
a / max(1, b)), where a toxic and b clean examples have it. So a word that toxic
examples share counts for more than a chance one, and none counts for nothing.
Terms that no example has can add to no dot product; they are left out.

The examples are a bounded sample of the labelled rows, by a hash of doc_id: at
most `toxic` and `clean` of either label, with their whole texts. All else covers
all documents: the document frequencies, and the search, which is exact.

The search uses a block-max inverted index. Examples are ordered by their
strongest term and cut into blocks. Short postings lists are added up whole. The
FREQUENT longest lists carry the greatest weight of each block: what they can add
at most, on top of what the short lists gave, bounds a block. Blocks of the greatest
bounds are taken first; then all others whose bound reaches the k-th similarity
found there. Queries go through the index many at a time.

Labels, lang, source and doc_id are never inputs of a score. Labels are learned
from rows that `held_out` leaves; null labels are no labels, and of rows that
repeat doc_id in labels, toxic wins; of rows that repeat doc_id in docs, the
one of the least vector is the example.

Defined results: a text without any term of the examples, as null and empty ones,
has no evidence and the vote 0; without any examples all scores are 0; examples of
similarity 0 have no vote; equally near ones are taken in the index's order;
doc_id may be of any type that has an order; repeated rows get equal results; an
empty table gives no rows; other columns are ignored, so their names cannot
clash. Texts are always read whole, of any length.
"""

from __future__ import annotations

import gc
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _store
from millrace.llm._arrow import slices

PREFIXES = (5,)
#: How much relevance counts: a term's weight has it to this power.
RELEVANCE = 2.5
BLOCK = 32
#: Postings lists that are bounded by block.
FREQUENT = 512
#: Queries that go through the index at a time.
BATCH = 256
NEAREST = 31
#: What a word may carry at either end of its token.
EDGES = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¡¿·"


def terms(token: str) -> tuple[str, ...]:
    """Terms of one token: the word, and beginnings of it marked by ^."""
    word = token if token.isalpha() else token.strip(EDGES)
    return (word, *[f"^{word[:k]}" for k in PREFIXES if len(word) > k]) if word else ()


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning: the CRC-32 of doc_id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def examples(labels: DataFrame, toxic: int, clean: int) -> tuple[DataFrame, dict[int, int]]:
    """Sampled doc_id and label, and how many labelled rows of either label there are to learn from."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("label"))
    )
    known = _store.materialise(known, "labelled")
    there = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pick = lambda label, n: known.filter(F.col("label") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n)
    return _store.materialise(pick(1, toxic).union(pick(0, clean)), "sampled"), {0: there.get(0, 0), 1: there.get(1, 0)}


def vocabulary(texts: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts (label, text), in order, and the relevance frequency of each."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source, 64):
            seen = (Counter(), Counter())
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                seen[label].update({t for token in set((text or "").lower().split()) for t in terms(token)})
            known = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(known, pa.string()), pa.array([seen[1][t] for t in known], pa.int64()), pa.array([seen[0][t] for t in known], pa.int64())],
                ["term", "a", "b"],
            )

    counted = texts.select("label", "text").mapInArrow(batches, "term string, a long, b long").groupBy("term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    found = _store.materialise(counted, "terms").toArrow().sort_by("term")  # terms of at most toxic + clean texts
    a, b = (found.column(c).to_numpy().astype(float) for c in ("a", "b"))
    return found.column("term").combine_chunks(), np.log2(2 + a / np.maximum(1, b))


class Tokens(dict):
    """Number of each token met lately; places has its terms' places in the vocabulary, -1 for none."""

    MOST, WIDTH = 1 << 18, 1 + len(PREFIXES)

    def __init__(self, place: dict[str, int]):
        self.place = place
        self.places = array("i")

    def __missing__(self, token: str) -> int:
        k = self[token] = len(self)
        known = [self.place.get(t, -1) for t in terms(token)]
        self.places.extend(known + [-1] * (self.WIDTH - len(known)))
        return k

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's terms in a text, in order, and how often they occur."""
        found = text.lower().split()
        if len(self) >= self.MOST:
            self.clear()
            self.places = array("i")
        numbers = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        ids = np.frombuffer(self.places, np.int32).reshape(-1, self.WIDTH)[numbers].ravel()
        return np.unique(ids[ids >= 0], return_counts=True)


def vectors(docs: DataFrame, words: pa.Array) -> DataFrame:
    """doc_id, ids (in order) and tfs: the vocabulary's terms in each text and how often they occur."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens({w: i for i, w in enumerate(words.to_pylist())})
        for batch in slices(source):
            ids, tfs = zip(*[tokens.counts(text or "") for text in batch.column("text").to_pylist()])
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.ListArray.from_arrays(ends, np.concatenate(x).astype(np.int32)) for x in (ids, tfs)]],
                ["doc_id", "ids", "tfs"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, ids array<int>, tfs array<int>")


@dataclass
class BlockMax:
    """The examples' inverted index: term t's postings are at[t]:at[t+1]; weight: of each term."""

    weight: np.ndarray
    doc_ids: list
    labels: np.ndarray
    at: np.ndarray
    posted: np.ndarray
    weights: np.ndarray

    @staticmethod
    def vector(weight: np.ndarray, ids, tfs) -> tuple[np.ndarray, np.ndarray]:
        """Ids and weights, of length one together."""
        ids = np.asarray(ids, np.int64)
        raw = (1 + np.log(np.asarray(tfs, float))) * weight[ids]
        return ids, raw / max(float(np.sqrt(raw @ raw)), 1e-300)

    @classmethod
    def build(cls, weight: np.ndarray, rows: list[tuple]) -> BlockMax:
        """rows: doc_id, label, ids, tfs."""
        flat = lambda c: np.array([x for r in rows for x in r[c]], np.int64)
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        return cls.of(weight, [r[0] for r in rows], np.array([r[1] for r in rows], np.int64), sizes, flat(2), flat(3))[0]

    @classmethod
    def of(cls, weight: np.ndarray, doc_ids: list, labels: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> tuple[BlockMax, np.ndarray]:
        """The index, and which example is at each of its places. ids and tfs hold all examples' terms, one after the other."""
        n = len(doc_ids)
        value = (1 + np.log(tfs)) * weight[ids]
        row = np.repeat(np.arange(n), sizes)
        value /= np.maximum(np.sqrt(np.bincount(row, value**2, minlength=n)), 1e-300)[row]
        strongest = np.full(n, -1)
        by_value = np.lexsort((ids, -value, row))
        filled = sizes > 0
        strongest[filled] = ids[by_value[(np.cumsum(sizes) - sizes)[filled]]]
        order = np.array(sorted(range(n), key=lambda k: (strongest[k], doc_ids[k])), np.int64)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        place = place[row]
        by_term = np.lexsort((place, ids))
        at = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(weight)))))
        return cls(weight, [doc_ids[k] for k in order], labels[order], at, place[by_term].astype(np.int32), value[by_term]), order

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Column of each term among the longest lists, or -1; their weights by example; the greatest of each block; where blocks begin."""
        n = len(self.labels)
        longest = np.argsort(self.at[:-1] - self.at[1:], kind="stable")[:FREQUENT]
        column = np.full(len(self.weight), -1)
        column[longest] = np.arange(len(longest))
        dense = np.zeros((n, len(longest)))
        for k, t in enumerate(longest):
            dense[self.posted[self.at[t] : self.at[t + 1]], k] = self.weights[self.at[t] : self.at[t + 1]]
        starts = np.arange(0, n, BLOCK)
        return column, dense, np.maximum.reduceat(dense, starts), starts

    def nearest(self, queries: list[tuple], k: int = NEAREST, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, tfs): places and similarities of the k most similar examples, nearest first.

        Those of similarity 0 are left out, and the place that `but` has for the query.
        """
        n, q = len(self.labels), len(queries)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * q
        column, dense, tops, starts = self.frequent
        made = [self.vector(self.weight, ids, tfs) for ids, tfs in queries]
        row = np.repeat(np.arange(q), [len(ids) for ids, _ in made])
        term, value = (np.concatenate([x[c] for x in made]) for c in (0, 1))
        often = column[term] >= 0
        wide = np.zeros((q, dense.shape[1]))
        wide[row[often], column[term[often]]] = value[often]
        total = np.zeros((q, n))
        for sums, (ids, values) in zip(total, made):  # one at a time, so that what is added up stays small
            short = column[ids] < 0
            lists = [slice(a, b) for a, b in zip(self.at[ids[short]].tolist(), self.at[ids[short] + 1].tolist())]
            if lists:
                added = np.concatenate([self.weights[s] for s in lists])
                added *= np.repeat(values[short], [s.stop - s.start for s in lists])
                sums += np.bincount(np.concatenate([self.posted[s] for s in lists]), added, minlength=n)
        bound = np.maximum.reduceat(total, starts, axis=1) + wide @ tops.T
        left = np.zeros((q, n), bool)  # whose similarity is known
        if but is not None:
            total[np.arange(q), but] = -np.inf

        def take(chosen: np.ndarray) -> None:
            for b in np.nonzero(chosen.any(axis=0))[0]:
                mine, s = np.nonzero(chosen[:, b])[0], slice(starts[b], starts[b] + BLOCK)
                total[mine, s] += wide[mine] @ dense[s].T
                left[mine, s] = True

        some = min(len(starts), -(-(k + 1) // BLOCK) + 3)
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argpartition(-bound, some - 1, axis=1)[:, :some], True, axis=1)
        take(first)
        least = np.full(q, -np.inf)
        for i, (known, sums) in enumerate(zip(left, total)):
            if len(found := sums[known]) >= k:
                least[i] = np.partition(found, -k)[-k]
        take(~first & (bound + 1e-9 >= least[:, None]))
        out = []
        for known, sums in zip(left, total):
            places = np.nonzero(known & (sums > 1e-12))[0]
            similar = np.round(sums[places], 12)
            if len(places) > k:
                near = similar >= np.partition(similar, -k)[-k]
                places, similar = places[near], similar[near]
            order = np.lexsort((places, -similar))[:k]
            out.append((places[order], similar[order]))
        return out

    def vote(self, places: np.ndarray, similar: np.ndarray) -> float:
        """Share of toxic among the examples, each weighted by the inverse of its distance."""
        if not len(places):
            return 0.0
        weight = 1 / (1.02 - similar)
        return float((weight * self.labels[places]).sum() / weight.sum())


def calibration(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the monotone map from vote to probability: pool adjacent violators, each pool smoothed by its size."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y, w in zip(votes[order], labels[order], weights[order]):
        pools.append([w * v, w * y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    rate = labels @ weights / weights.sum()
    x = [p[0] / p[2] for p in pools]
    y = np.maximum.accumulate([(p[1] + rate) / (p[2] + 1) for p in pools])
    return np.array(x), np.array(y)


def score(docs: DataFrame, labels: DataFrame, toxic: int = 2000, clean: int = 4000, nearest: int = NEAREST) -> DataFrame:
    """Per row: doc_id, held_out, score, vote, evidence (doc_id, label and similarity of the nearest examples)."""
    sampled, there = examples(labels, toxic, clean)
    few = sampled.select(F.col("doc_id").alias("_of"), "label")  # at most toxic + clean rows
    matched = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_of"))
    words, relevance = vocabulary(matched)
    known = _store.materialise(vectors(docs, words), "vectors")
    n = known.count()
    df = np.zeros(len(words))
    counted = known.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()  # a row per term at most
    df[counted.column("id").to_numpy()] = counted.column("count").to_numpy()
    weight = np.log(1 + n / (1 + df)) * relevance**RELEVANCE
    rows = (
        known.join(F.broadcast(few), F.col("doc_id") == F.col("_of"))
        .groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct("ids", "tfs")).alias("v"))
        .select("doc_id", "label", "v.ids", "v.tfs").toArrow().combine_chunks()
    )
    lists = [rows.column(c).combine_chunks() for c in ("ids", "tfs")]
    sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids, tfs = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    model, order = BlockMax.of(weight, rows.column("doc_id").to_pylist(), rows.column("label").to_numpy(), sizes, ids, tfs)
    used = Counter(model.labels.tolist())
    if len(used) == 2:
        ends, votes = np.cumsum(sizes), []
        for at in range(0, len(order), BATCH):
            part = range(at, min(len(order), at + BATCH))
            own = [slice(ends[k] - sizes[k], ends[k]) for k in order[part.start : part.stop]]
            votes += [model.vote(*x) for x in model.nearest([(ids[o], tfs[o]) for o in own], nearest, list(part))]
        points = calibration(np.array(votes), model.labels.astype(float), np.array([there[y] / used[y] for y in model.labels.tolist()]))
    else:
        points = np.array([0.0, 1.0]), np.array([0.0, 0.0])
    del rows, lists, ids, tfs, counted, df
    gc.collect()
    pa.default_memory_pool().release_unused()
    model.__dict__.pop("frequent", None)  # each worker makes its own
    kind = dict(docs.dtypes)["doc_id"]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: dict[tuple[bytes, bytes], tuple] = {}  # vectors met lately

        for batch in slices(source, BATCH):
            ends = np.cumsum(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False))
            ids, tfs = (np.split(batch.column(c).flatten().to_numpy(), ends[:-1]) for c in ("ids", "tfs"))
            keys = [(a.tobytes(), b.tobytes()) for a, b in zip(ids, tfs)]
            if len(judged) >= 1 << 12:
                judged.clear()
            new = {key: (a, b) for key, a, b in zip(keys, ids, tfs) if key not in judged}
            for key, (places, similar) in zip(new, model.nearest(list(new.values()), nearest) if new else ()):
                vote = model.vote(places, similar)
                # The vote itself decides between texts of one calibrated level.
                level = 0.999 * float(np.interp(vote, *points)) + 0.001 * vote if len(used) == 2 else 0.0
                why = [
                    {"doc_id": model.doc_ids[p], "label": int(model.labels[p]), "similarity": float(s)}
                    for p, s in zip(places[:3].tolist(), similar[:3])
                ]
                judged[key] = level, vote, why
            found = [judged[key] for key in keys]
            evidence = pa.list_(pa.struct([("doc_id", batch.column("doc_id").type), ("label", pa.int32()), ("similarity", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x[0] for x in found], pa.float64()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], evidence),
                ],
                ["doc_id", "score", "vote", "evidence"],
            )

    return known.mapInArrow(
        batches, f"doc_id {kind}, score double, vote double, evidence array<struct<doc_id:{kind},label:int,similarity:double>>"
    ).withColumn("held_out", held_out(F.col("doc_id")))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, labels).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "vote", "evidence"
    )


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
