import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import _components, simhash
from tests.llm import edge


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_as_brute_force(spark):
    docs, texts = edge.documents(spark)
    out = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    fps = sorted({fingerprint(t) for _, t in texts})
    root = edge.roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for d, t in texts:
        if d is not None:
            r = root[fingerprint(t)]
            least[r] = min(least.get(r, d), d)
    want = [(d, fingerprint(t), least.get(root[fingerprint(t)])) for d, t in texts]
    assert sorted(map(repr, out)) == sorted(map(repr, want))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [3, 64, 4096])
def test_links_lose_no_component_whatever_the_tile(spark, tile):
    r = random.Random(5)
    fps = set()
    for _ in range(120):
        base = r.getrandbits(64) & 0xFFFF_FFFF_0000_FFFF  # many share a quarter
        fps.add(base)
        for _ in range(r.randint(0, 5)):
            base ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
            fps.add(base)
    fps = sorted(fps)
    signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.links(frame, tile=tile)
    for a, b in ((x["a"], x["b"]) for x in links.collect()):
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    got = {x["node"]: x["root"] for x in _components.components(links).collect()}
    want = edge.roots(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {x: got.get(x, x) for x in signed} == want


def test_a_long_chain_is_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = _components.components(links).collect()
    assert len(got) == 301 and {x["root"] for x in got} == {0}
    assert _components.components(links.limit(0)).count() == 0


def test_deduplicated_keeps_one_document_of_each_component(spark):
    docs, texts = edge.documents(spark)
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    ids = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert {r["doc_id"] for r in out.collect()} == ids


def test_deduplicated_keeps_one_row_where_ids_are_null_or_repeated(spark):
    a, b, c = (edge.words(k, 300) for k in (31, 32, 33))
    rows = [(None, a), (None, a + " "), (None, a.upper()), (4, b), (4, b + " "), (4, b), (4, c), (3, c + " "), (None, c)]
    docs = edge.plain(spark, [(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)])
    out = simhash.deduplicated(docs).collect()
    parts = {x: {fingerprint(t) for _, t in rows if t.strip().lower() == x} for x in (a, b, c)}
    assert all(len(x) == 1 for x in parts.values())
    assert sorted((r["doc_id"] or 0, r["text"].strip().lower()) for r in out) == sorted([(0, a), (4, b), (3, c)])
