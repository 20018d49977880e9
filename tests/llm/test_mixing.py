from collections import Counter, defaultdict

import pytest

from millrace.llm import mixing
from tests.llm import edge


@pytest.mark.parametrize("shares", [mixing.TARGET, {"a": 9, "b": 1}, {"a": 90, **{f"x{i}": 1 for i in range(10)}}, {"a": 1}, {"a": 3, "b": 3, "c": 1}])
def test_schedule_keeps_every_window_and_every_prefix(shares):
    period, out = sum(shares.values()), mixing.schedule(shares)
    assert Counter(lane for lane, _ in out) == shares
    done = Counter()
    for slot, (lane, block) in enumerate(out):
        release, deadline = mixing.window(block, shares[lane], period)
        assert release <= slot < deadline and done[lane] == block
        done[lane] += 1
        for x, share in shares.items():
            assert abs(done[x] * period - (slot + 1) * share) < period


def rows(spark, n, sources):
    return edge.plain(spark, [(i, "t", "en", sources[i % len(sources)], i % 5) for i in range(n)])


def test_mix_is_whole_and_on_target(spark):
    shares, size = {"a": 5, "b": 3, mixing.REST: 2}, 4
    out = mixing.mix(rows(spark, 1000, ["a", "a", "b", "c", None]), shares, size).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(1000)) and len({r["doc_id"] for r in out}) == 1000
    taken = Counter()
    for r in out:
        if not r["on_target"]:
            break
        assert r["release"] <= r["slot"] < r["deadline"]
        taken[r["lane"]] += 1
        for lane, share in shares.items():
            # Less than one block wherever a block ends; within a block, that much more.
            assert abs(taken[lane] - (r["position"] + 1) * share / 10) < (size if (r["position"] + 1) % size == 0 else 2 * size)
    assert sum(taken.values()) > 400
    by_slot = defaultdict(set)
    for r in out:
        by_slot[r["slot"]].add((r["lane"], r["block"]))
    assert all(len(x) == 1 for x in by_slot.values())


def test_lanes_without_documents_take_no_slots(spark):
    shares, size = {"a": 6, "b": 3, "gone": 4, mixing.REST: 2}, 4
    out = mixing.mix(rows(spark, 900, ["a", "a", "b"]), shares, size).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(900)) and [r["slot"] for r in out] == [k // size for k in range(900)]
    taken = Counter()
    for r in out:
        assert r["on_target"] and r["release"] <= r["slot"] < r["deadline"]
        taken[r["lane"]] += 1
        for lane, share in {"a": 6, "b": 3}.items():
            assert abs(taken[lane] - (r["position"] + 1) * share / 9) < (size if (r["position"] + 1) % size == 0 else 2 * size)
    given = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert given.filter("on_target").count() > 100 * mixing.BLOCK_DOCS / 10


def test_buckets_do_not_change_the_order(spark):
    docs = rows(spark, 700, ["a", "b"])
    order = lambda b: [r["doc_id"] for r in mixing.placed(docs, {"a": 1, "b": 1}, 4, b).select("_row.doc_id", "position").orderBy("position").collect()]
    assert order(10) == order(10_000)


def test_awkward_and_empty_tables(spark):
    docs, texts = edge.documents(spark)
    out = mixing.mix(docs)
    assert sorted(r["position"] for r in out.collect()) == list(range(len(texts)))
    assert mixing.mix(docs.limit(0)).count() == 0
    laid = mixing.mixed(docs)
    assert laid.columns == docs.columns and sorted(map(repr, laid.collect())) == sorted(map(repr, docs.collect()))
