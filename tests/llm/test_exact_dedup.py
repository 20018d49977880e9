import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import exact_dedup
from tests.llm import edge


def brute(texts):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t in texts:
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t in texts:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: x[:3])[3]
        out.append((d, keep, len(g), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def told(out):
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("h"))


def test_classes_as_brute_force_with_awkward_rows(spark):
    docs, texts = edge.documents(spark)
    for capacity in (1, 50_000):
        assert sorted(repr(tuple(r)) for r in told(exact_dedup.classes(docs, capacity)).collect()) == sorted(map(repr, brute(texts)))
    assert exact_dedup.classes(docs.limit(0)).count() == 0 and exact_dedup.deduplicated(docs.limit(0)).count() == 0


def test_directory_splits_only_overfull_buckets_however_deep(spark):
    keys = spark.createDataFrame([(k,) for k in [*range(100), -1, -2, 1 << 62]], "key long")
    for capacity in (1, 10, 200):
        found, depth = exact_dedup.directory(keys, capacity)
        slots = {r["slot"]: (r["local"], r["bucket"]) for r in found.collect()}
        held = defaultdict(list)
        for k in [*range(100), -1, -2, 1 << 62]:
            local, bucket = slots[((k % (1 << 64)) >> (64 - depth)) if depth < 64 else k]
            held[local, bucket].append(k % (1 << 64))
        assert max(map(len, held.values())) <= capacity
        for (local, _), mine in held.items():
            # A bucket is all keys of its leading bits, and with one bit less it would be overfull.
            same = lambda bits: [k for k in [*range(100), (1 << 64) - 1, (1 << 64) - 2, 1 << 62] if k >> (64 - bits) == mine[0] >> (64 - bits)]
            assert sorted(same(local)) == sorted(mine) and (local == 0 or len(same(local - 1)) > capacity)


def test_colliding_keys_are_chained_by_their_bytes(spark, monkeypatch):
    texts = [(1, "a b"), (2, "b"), (3, "ab"), (4, " b"), (5, "c"), (6, None), (7, "b"), (None, "c")]
    docs = edge.plain(spark, [(d, t, None, None, 1) for d, t in texts])
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("bigint"))  # all keys collide
    out = exact_dedup.classes(docs).collect()
    stay = exact_dedup.deduplicated(docs).collect()
    monkeypatch.undo()
    want = {repr(x[0]): x for x in brute(texts)}
    assert {repr(r["doc_id"]): (r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["sha"].hex()) for r in out} == want
    assert len({(r["key"], r["chain"]) for r in out}) == len({r["sha"] for r in out}) == 4
    assert sorted(r["doc_id"] for r in stay) == sorted({x[1] for x in want.values()})


def test_hot_texts_and_ids_of_other_types(spark):
    rows = [(f"id{k:04}", "one and the same" + " " * (k % 3)) for k in range(300)] + [(f"x{k}", f"text {k // 2}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    out = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.classes(docs, 4).collect()}
    assert out["id0299"] == ("id0002", 300) and out["x1"] == ("x0", 2) and len(out) == 340
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicated(docs, 4).collect()) == sorted(["id0002", *[f"x{k}" for k in range(0, 40, 2)]])
    lowest = spark.createDataFrame([(-(1 << 63), "t"), (5, "t")], "doc_id long, text string")
    assert exact_dedup.classes(lowest).first()["keep_id"] == -(1 << 63)


def test_owners_compare_and_nothing_else_groups_texts(spark):
    docs, _ = edge.documents(spark)
    rows = docs.select("doc_id", exact_dedup._best(F.col("text")).alias("best"), exact_dedup.normalised(F.col("text")).alias("norm"))
    entries = rows.withColumn("key", F.xxhash64("norm"))
    keys, total = exact_dedup.counted(entries)
    plan = exact_dedup.index(entries, keys, 10**9, *exact_dedup.directory(keys))._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
    assert any(re.fullmatch(r"bucket#\d+L?", x) for x in dealt) and not any("sha" in x for x in dealt)


def test_deduplicated_keeps_one_whole_row_of_each_class(spark):
    docs, texts = edge.documents(spark)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    want = {(k, h) for _, k, _, _, h in brute(texts)}
    assert len(kept) == len(want) == len({h for _, h in want}) and {d for d, _ in kept} == {k for k, _ in want}
