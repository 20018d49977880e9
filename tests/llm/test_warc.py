import gzip
import hashlib
import io
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import _store, warc

BIG = "<p>" + "x" * 200 + "</p>"
PAGES = [
    (5, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/3", BIG), (1, "http://a/4", "small"), (3, "http://a/5", "small"), (4, None, None),
    (6, "http://a/6\r\nX: y", ""), (7, "http://a/é", "é" * 60), (8, "http://a/8", "é" * 60), (None, "http://a/9", BIG), (10, "http://a/10", "WARC/1.1\r\n\r\n" * 40),
    (11, "http://a/11", "z" * 3_000_000), (12, "http://a/12", "y" * 99), (13, "http://a/13", "y" * 99), (14, "http://a/14", "w" * 100), (14, "http://a/14", "w" * 100),
]


def brute(pages):
    groups = defaultdict(list)
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            groups[h].append(i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = min(groups[h]) if groups.get(h) else None
        again = first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def folder(spark):
    path = _store.fresh_path(spark, "warc-test")
    pages = spark.createDataFrame([(*p, "sha", "first") for p in PAGES], "page_id long, url string, html string, sha string, first string")
    warc.write_pages(pages.repartition(3), path)
    return path


def test_archives_read_back_whole(spark, folder):
    rows = spark.read.format("warc").load(folder).collect()
    got = []
    for r in rows:
        if r["record_type"] == "response":
            assert r["payload_digest"] == "sha256:" + hashlib.sha256(r["payload"]).hexdigest() and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["payload"] is None and r["refers_to_id"] == f"<urn:millrace:page:{r['refers_to_page']}>"
        got.append((r["page_id"], r["payload_bytes"], r["payload_digest"][7:], r["record_type"], r["refers_to_page"]))
    assert sorted(map(repr, got)) == brute(PAGES)
    assert {r["target_uri"] for r in rows if r["page_id"] in (4, 6)} == {None, "http://a/6%0D%0AX: y"}


def test_pushdown_and_skipped_payloads(spark, folder):
    back = spark.read.format("warc").option("payload", "false").load(folder)
    assert back.filter("payload IS NOT NULL").count() == 0 and back.count() == len(PAGES)
    full = spark.read.format("warc").load(folder)
    found = full.filter((F.col("record_type") == "revisit") & F.col("page_id").isin(5, 9, 2))
    assert sorted(r["page_id"] for r in found.collect()) == [5, 9]
    assert full.filter(F.col("target_uri").startswith("http://a/1")).filter("page_id > 10").count() == 5


def test_the_reader_takes_filters_and_skips_by_length():
    class Options:
        pass

    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructType

    reader = warc.WarcReader({"path": "/none"}, StructType.fromDDL(warc.SCHEMA))
    kept = [EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 3)]
    assert list(reader.pushFilters(kept)) == [kept[1]]
    assert reader.wanted({"warc-type": "revisit"}) and not reader.wanted({"warc-type": "response"}) and not reader.wanted({})


@pytest.mark.parametrize("pack", [warc.member, gzip.compress])
def test_members_with_and_without_lengths(pack):
    r = random.Random(1)
    records = []
    for i in range(400):
        payload = None if i % 7 == 3 else bytes(r.choices(b"abcdefgh <>\r\n", k=r.choice([0, 1, 50, 500, 5000, 40000])))
        records.append(({"WARC-Type": "revisit" if payload is None else "response", "WARC-Record-ID": f"<{i}>", "WARC-Target-URI": "u" * r.choice([1, 3000])}, payload))
    data = b"".join(pack(warc.record(*x)) for x in records)
    every = list(warc.read_records(io.BytesIO(data), 0, len(data), lambda h: True, True))
    assert [(h["warc-record-id"], p) for h, p in every] == [(h["WARC-Record-ID"], p) for h, p in records]
    some = list(warc.read_records(io.BytesIO(data), 0, len(data), lambda h: h["warc-type"] == "revisit", True))
    assert len(some) == sum(p is None for _, p in records)
    assert gzip.decompress(data) == b"".join(warc.record(*x) for x in records)


def test_folded_headers_and_cut_files():
    assert warc.parse_headers(b"WARC/1.1\r\nA: b\r\n c\r\nnone\r\nX:y") == {"a": "b c", "x": "y"}
    data = warc.member(warc.record({"WARC-Type": "response"}, b"x" * 5000))
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(data[: len(data) // 2]), 0, len(data), lambda h: True, True))


def test_only_committed_files_are_read_and_foreign_ones_without_a_manifest(spark, folder, tmp_path):
    extra = warc.member(warc.record({"WARC-Type": "response", "WARC-Record-ID": "<z>"}, b"lost"))
    place = folder.removeprefix("file://")
    with open(f"{place}/{warc._OWN}lost.warc.gz", "wb") as f:
        f.write(extra)
    assert spark.read.format("warc").load(folder).count() == len(PAGES)
    (tmp_path / "foreign.warc.gz").write_bytes(gzip.compress(warc.record({"WARC-Type": "response", "WARC-Record-ID": "<f>"}, b"hello")))
    row = spark.read.format("warc").load(str(tmp_path)).first()
    assert (row["record_id"], bytes(row["payload"])) == ("<f>", b"hello")


def test_chunks_of_a_file_are_read_apart(spark):
    path = _store.fresh_path(spark, "warc-chunks")
    warc.register(spark)
    rows = spark.range(500).select(
        F.lit("response").alias("record_type"), F.concat(F.lit("<"), "id", F.lit(">")).alias("record_id"), F.lit(None).cast("string").alias("refers_to_id"),
        F.lit("http://x/").alias("target_uri"), F.col("id").alias("page_id"), F.lit(None).cast("long").alias("refers_to_page"), F.lit("").alias("payload_digest"),
        F.lit(0).cast("long").alias("payload_bytes"), F.md5(F.col("id").cast("string")).cast("binary").alias("payload"),
    )
    rows.coalesce(1).write.format("warc").option("chunk", 2000).mode("append").save(path)
    back = spark.read.format("warc").load(path)
    assert back.rdd.getNumPartitions() > 10 and back.select("page_id").distinct().count() == 500


def test_empty_table(spark):
    path = _store.fresh_path(spark, "warc-empty")
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert spark.read.format("warc").load(path).count() == 0


def test_archives_of_other_tools_are_read_beside_those_of_this_writer(spark, tmp_path):
    extra = warc.member(warc.record({"WARC-Type": "response", "WARC-Record-ID": "<z>"}, b"found"))
    mine = str(tmp_path / "both")
    warc.write_pages(spark.createDataFrame([(1, "http://a", "one")], "page_id long, url string, html string"), f"file://{mine}")
    (tmp_path / "both" / "sub").mkdir()
    for name in ("part-other.warc.gz", "sub/more.warc.gz"):
        (tmp_path / "both" / name).write_bytes(extra)
    assert spark.read.format("warc").load(f"file://{mine}").count() == 3
    (tmp_path / "both" / "plain.warc").write_bytes(b"WARC/1.1\r\n\r\n")
    with pytest.raises(Exception, match="one gzip member per record"):
        spark.read.format("warc").load(f"file://{mine}").count()


def test_many_copies_are_dealt_where_they_are_too_many_to_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "_BROADCAST_ROWS", 0)
    pages = spark.createDataFrame([(k, None, "x" * 200) for k in range(40)], "page_id long, url string, html string")
    warc.write_pages(pages, f"file://{tmp_path}/m")
    back = spark.read.format("warc").load(f"file://{tmp_path}/m").collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to_page"]) for r in back) == [(0, "response", None), *[(k, "revisit", 0) for k in range(1, 40)]]
