import re
from collections import Counter

import numpy as np

from millrace.llm import quality
from tests.llm import edge

SF = "/root/testdata/sf0.1"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def test_counts_as_brute_force_with_awkward_rows(spark):
    docs, texts = edge.documents(spark)
    out = quality.judge(docs).collect()
    got = sorted(repr((r["doc_id"], *[r[c] for c in quality.COUNTS[:5]], r["base_failed"])) for r in out)
    want = []
    for d, t in texts:
        b = brute(t)
        want.append(repr((d, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])))
    assert got == sorted(want)
    assert not any(r["kept"] for r in out if r["base_failed"])
    assert quality.judge(docs.limit(0)).count() == 0 and quality.filtered(docs.limit(0)).count() == 0


def test_windows_of_texts_with_many_kinds_of_words():
    r = np.random.default_rng(0)
    ids = r.integers(0, 6, 500)
    assert quality.repeat_words(ids, 6) == quality.repeat_words(ids, 3_000_000) == brute(" ".join(f"w{i}" for i in ids))[4]


def test_fit_finds_accuracies_of_simulated_rules():
    r = np.random.default_rng(1)
    bad = r.random(20_000) < 0.2
    votes = []
    for hit, false in ((0.7, 0.01), (0.5, 0.02)):
        votes.append(np.where(np.where(bad, r.random(20_000) < hit, r.random(20_000) < false), quality.BAD, quality.ABSTAIN))
    for hit, false in ((0.9, 0.2), (0.8, 0.1), (0.85, 0.15)):
        votes.append(np.where(np.where(bad, r.random(20_000) < false, r.random(20_000) < hit), quality.GOOD, quality.ABSTAIN))
    kinds, n = np.unique(np.array(votes).T, axis=0, return_counts=True)
    model = quality.fit(kinds, n.astype(float))
    assert abs(model.prior - 0.2) < 0.03 and abs(model.rates[0, 0, quality.BAD] - 0.7) < 0.05
    assert abs(model.rates[1, 2, quality.GOOD] - 0.9) < 0.03 
    cast = [(0.2 * h, 0.8 * f) for h, f in ((0.7, 0.01), (0.5, 0.02))] + [(0.8 * h, 0.2 * f) for h, f in ((0.9, 0.2), (0.8, 0.1), (0.85, 0.15))]
    assert np.abs(model.accuracy - [right / (right + wrong) for right, wrong in cast]).max() < 0.03


def test_clean_labelled_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r["kept"], labels[r["doc_id"]]) for r in quality.judge(docs).filter("NOT base_failed").collect() if r["doc_id"] in labels]
    assert sum(k for k, q in judged if q == 1) > 0.995 * sum(q == 1 for _, q in judged)
    assert sum(k for k, q in judged if q == 0) < 0.02 * sum(q == 0 for _, q in judged)


def test_filtered_gives_the_kept_rows_whole(spark):
    docs, _ = edge.documents(spark)
    out = quality.filtered(docs)
    assert out.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in out.collect()) == sorted(repr(r["doc_id"]) for r in quality.judge(docs).filter("kept").collect())


def test_few_distinct_words_are_seen_at_any_length(spark):
    r = np.random.default_rng(2)
    few = lambda n, kinds: " ".join(f"w{i}" for i in r.permutation(np.arange(n) % kinds))
    sizes = [(1000, 90), (1000, 110), (1999, 190), (2000, 190), (2000, 210), (8000, 390), (8000, 410), (50_000, 900), (50_000, 1100)]
    docs = edge.plain(spark, [(k, few(*x), "en", "s", 1) for k, x in enumerate(sizes)])
    rule = next(x for x in quality.RULES if x.name == "variety")
    got = {x["doc_id"]: x["v"] for x in quality.judge(docs).select("doc_id", rule.vote.alias("v")).collect()}
    assert [got[k] == quality.BAD for k in range(len(sizes))] == [True, False, True, True, False, True, False, True, False]
