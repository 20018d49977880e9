"""SimHash near-dedup by tiled exact comparison.

A document's fingerprint has 64 bits: a bit is 1 if it is set in over half of
the XXH64 hashes of the document's three-word shingles. Two fingerprints link at
`RADIUS` or fewer differing bits, and linked documents form components.

Only distinct fingerprints are compared, so copies cost nothing. Two of them
within 3 bits agree on one quarter of their bits at least: for each quarter, the
fingerprints that share its value form a band. A band is ordered by population
count and cut into tiles of `TILE` fingerprints. Two tiles of a band are
compared exactly, by numpy exclusive-or and bit counts, unless their population
counts differ by more than the radius: then no two of their members can link.
Of a pair of tiles only a spanning forest of its links is kept, which has the
same components and fewer links than the tiles have members.

Nothing is sampled or capped: a band of any size is cut into more tiles.

Defined results: null and empty texts have fingerprint zero and link to each
other and to any fingerprint with 3 bits or fewer; a null doc_id takes part, and
is a component's id only if all its doc_ids are null; repeated rows get equal
results; an empty table gives no rows; other columns are ignored, so their names
cannot clash. Texts are always read whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _components, _hot, _ranks, _store
from millrace.llm._arrow import slices

RADIUS = 3
TILE = 2048
SEED = 42
_CHUNK = 1 << 14


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # for bytes: A-Z only; at space, and 9 to 13
    n = max(1, len(words) - 2)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    lasts = ends[min(3, len(words)) - 1 :] - 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : min(n, at + _CHUNK)].tolist(), lasts[at : min(n, at + _CHUNK)].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            found = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right, which may be one and the same."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    a, b = left.view(np.uint64), right.view(np.uint64)
    rows = max(1, (1 << 19) // max(1, len(b)))  # a block of half a million pairs at a time
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
        for i, j in zip(*np.nonzero(near)):
            x, y = int(left[at + i]), int(right[j])
            if x != y and (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
    return out


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links a, b among the distinct `fp` of fps that keep all components of radius or fewer bits."""
    width = 64 // (radius + 1)
    bands = fps.select(
        "fp",
        F.expr("bit_count(fp)").cast("int").alias("ones"),
        F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("band"),
    ).withColumn("value", F.expr(f"shiftrightunsigned(fp, {width} * band) & {(1 << width) - 1}L"))
    # A band is numbered in pieces: by population count, and by the leading bits of the fingerprint.
    piece = F.struct("ones", F.expr("shiftright(fp, 56)").alias("lead"))
    placed = _ranks.numbered(bands, ["band", "value"], piece, [F.col("ones"), F.col("fp")], "place")
    tiles = _store.materialise(
        placed.withColumn("tile", F.floor(F.col("place") / tile))
        .groupBy("band", "value", "tile")
        .agg(F.collect_list("fp").alias("fps"), F.min("ones").alias("least"), F.max("ones").alias("most"))
        .filter((F.size("fps") > 1) | (F.col("tile") > 0)),
        "tiles",
    )
    alone = tiles.select(F.col("fps").alias("left"), F.col("fps").alias("right"))
    # Only bands of more than one tile have pairs; a lone last tile still meets the ones before it.
    shape = tiles.select("band", "value", "tile", "least", "most")
    other = shape.select("band", "value", *[F.col(c).alias(f"o_{c}") for c in ("tile", "least", "most")])
    met = shape.join(other, ["band", "value"]).filter(
        (F.col("tile") < F.col("o_tile")) & (F.col("o_least") - F.col("most") <= radius)
    )
    key = ["band", "value"]
    first = tiles.select(*key, "tile", F.col("fps").alias("left"))
    second = tiles.select(*key, F.col("tile").alias("o_tile"), F.col("fps").alias("right"))
    across = met.select(*key, "tile", "o_tile").join(first, [*key, "tile"]).join(second, [*key, "o_tile"]).select("left", "right")

    def compared(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sides = [
                (c.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy()))))
                for c in (batch.column("left"), batch.column("right"))
            ]
            found = []
            (lv, lo), (rv, ro) = sides
            for k in range(batch.num_rows):
                found += forest(lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]], radius)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return alone.union(across).mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Per row: doc_id, fp, component_id (least doc_id of its component)."""
    marked = _store.materialise(fingerprints(docs), "fingerprints")
    known = _store.materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = _components.components(links(known.select("fp"), radius, tile), "simhash").select(
        F.col("node").alias("fp"), "root"
    )
    rooted = _store.materialise(known.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    size = rooted.agg(F.count("*").alias("fps"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    # Neither a component of very many fingerprints nor a fingerprint of very many rows is dealt to one task.
    found = _hot.looked_up(rooted, named, "root", "fps", size["fps"]).select("fp", "component_id", "n")
    return _hot.looked_up(marked, _store.materialise(found, "components"), "fp", "n", size["rows"])


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component, with all columns.

    It is the row of the least doc_id, nulls last, then of the least digest of its
    text; of rows equal in both, the least row.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), radius).filter("doc_id = component_id")
    stay = _store.materialise(found.select(F.col("doc_id").alias("_id")), "stay")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_doc"))
    out = rows.join(stay.distinct().hint("shuffle_hash"), F.col("_doc") == F.col("_id"), "left_semi")
    if stay.count() > stay.distinct().count():  # rows that repeat doc_id and text
        out = out.groupBy("_doc").agg(F.min("_row").alias("_row"))
    return out.select("_row.*")


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


QUERIES = {"op5_simhash_near_dedup": op5_simhash_near_dedup}
ORACLES: dict[str, str] = {}
