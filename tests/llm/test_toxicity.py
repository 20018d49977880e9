import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import toxicity
from tests.llm import edge

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("seed", range(3))
def test_block_max_search_is_exact(seed, monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT", (0, 20, 500)[seed])
    r, n_terms = random.Random(seed), 200
    weight = np.array([0.2 + 3 * r.random() for _ in range(n_terms)])
    vector = lambda: (ids := sorted(r.sample(range(n_terms), r.randint(0, 12))), [r.randint(1, 5) for _ in ids])
    rows = [(i, r.randint(0, 1), *vector()) for i in range(900)]
    model, by = toxicity.BlockMax.build(weight, rows), {x[0]: x for x in rows}

    def dense(ids, tfs):
        i, w = model.vector(weight, ids, tfs)
        out = np.zeros(n_terms)
        out[i] = w
        return out

    matrix = np.array([dense(*by[d][2:]) for d in model.doc_ids])
    queries = [vector() for _ in range(100)]
    for but in (None, [7] * 100):
        for query, (places, similar) in zip(queries, model.nearest(queries, 31, but)):
            want = matrix @ dense(*query)
            if but:
                want[7] = -1
            want = np.round(want, 12)
            order = np.lexsort((np.arange(len(want)), -want))[:31]
            order = order[want[order] > 0]
            assert np.allclose(similar, want[order], atol=1e-9) and np.allclose(want[places], want[order], atol=1e-9)


def test_few_examples():
    model = toxicity.BlockMax.build(np.ones(2), [(1, 1, [0], [1])])
    assert model.nearest([([0], [1])])[0][0].tolist() == [0] and len(model.nearest([([0], [1])], but=[0])[0][0]) == 0
    assert len(model.nearest([([1], [1])])[0][0]) == 0
    none = toxicity.BlockMax.build(np.ones(0), [])
    assert none.vote(*none.nearest([([], [])])[0]) == 0.0


def test_scores_as_plain_code_from_texts_on(spark):
    r = random.Random(8)
    pool = [edge.words(r.random(), 1).strip(".") for _ in range(60)] + ["Idiot!", "idiots", "(scum)", "z" * 50]
    texts = {k: " ".join(r.choices(pool, k=r.randint(0, 25))) for k in range(150)}
    rows = [(k, t, "en", "s", 1) for k, t in texts.items()]
    toxic = {k: int("idiot" in t.lower()) for k, t in texts.items() if k % 4}
    labels = spark.createDataFrame([(k, 0, y) for k, y in toxic.items()], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(edge.plain(spark, rows), labels, nearest=7).collect()}

    def counts(text):
        out = Counter()
        for token in text.lower().split():
            word = re.sub(r"^[^a-z]+|[^a-z]+$", "", token)
            out.update([word, *["^" + word[:5] for _ in "1" if len(word) > 5]])
        return out

    bags = {k: counts(t) for k, t in texts.items()}
    train = [k for k in toxic if zlib.crc32(str(k).encode()) % 3 != 1]
    have = lambda t, y: sum(t in bags[k] for k in train if toxic[k] == y)
    weight = {}
    for t in set().union(*(bags[k] for k in train)):
        idf = math.log(1 + len(texts) / (1 + sum(t in b for b in bags.values())))
        weight[t] = idf * math.log2(2 + have(t, 1) / max(1, have(t, 0))) ** 2.5

    def unit(bag):
        raw = {t: (1 + math.log(n)) * weight[t] for t, n in bag.items() if t in weight}
        return {t: w / math.sqrt(sum(x * x for x in raw.values())) for t, w in raw.items()}

    units = {k: unit(b) for k, b in bags.items()}

    def vote(k, but=None):
        near = sorted(((round(sum(w * units[e].get(t, 0) for t, w in units[k].items()), 12), e) for e in train if e != but), reverse=True)
        near = [(s, e) for s, e in near if s > 1e-12]
        if not near:
            return 0.0, True
        sure = len(near) <= 7 or near[6][0] - near[7][0] > 1e-9  # no tie at the border
        share = [(1 / (1.02 - s), toxic[e]) for s, e in near[:7]]
        return sum(w * y for w, y in share) / sum(w for w, _ in share), sure

    own = [(vote(e, e)[0], toxic[e]) for e in train]
    x, y = toxicity.calibration(np.array([v for v, _ in own]), np.array([float(t) for _, t in own]), np.ones(len(own)))
    checked = 0
    for k in texts:
        v, sure = vote(k)
        if sure:
            checked += 1
            assert math.isclose(got[k]["vote"], v, abs_tol=1e-9)
            assert math.isclose(got[k]["score"], 0.999 * np.interp(v, x, y) + 0.001 * v, abs_tol=1e-3)
    assert checked > 100


def test_calibration_is_monotone():
    r = np.random.default_rng(0)
    votes = r.random(500)
    x, y = toxicity.calibration(votes, (r.random(500) < votes).astype(float), np.ones(500))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] < 0.3 and 0.7 < y[-1] < 1


def test_held_out_accuracy_and_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items())
    held = [(out[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    right = sum(y for s, y in held if s >= 0.7)
    assert right / sum(s >= 0.7 for s, _ in held) > 0.98 and right / sum(y for _, y in held) > 0.86
    # Whatever is told about held-out rows, or besides the text, changes nothing.
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1).otherwise(toxicity.F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs.withColumn("lang", toxicity.F.lit("zz")), other).collect()}
    assert all(abs(again[d] - r["score"]) < 1e-12 for d, r in out.items())


def test_awkward_and_empty_tables(spark):
    docs, texts = edge.documents(spark)
    labels = spark.createDataFrame(
        [(1, 0, 1), (1, 0, 0), (2, 1, None), (8, 1, 0), (None, 1, 1), (17, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int"
    )
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0
