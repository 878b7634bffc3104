"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_names, salted_join, written

#: Eight bytes in two halves; of any five bytes three lie in one half, so a pair that shares five bytes shares a triple.
TRIPLES = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 7), (4, 6, 7), (5, 6, 7)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a whole text as a signed integer; a text without words has 0."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """All columns of docs and `out`, the signed 64-bit fingerprint of the whole text."""

    @F.arrow_udf("bigint")
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((fingerprint(x.as_py()) for x in batch), pa.int64())

    return docs.withColumn(out, column(F.col(text)))


def close_pairs(fps: DataFrame, most: int = 3) -> DataFrame:
    """Pairs a < b of the distinct fingerprints `fp` that differ in at most `most` (<= 3) bits, each once.

    Posting lists belong to the positions and values of byte triples; a pair is tallied at the first list that both
    share, kept when at least 8 - most of its positional bytes agree, and verified on the differing bits.
    """
    if most > 3:
        raise ValueError("byte triples guarantee a shared list only up to 3 differing bits")

    def byte(x, i: int):
        return F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255).cast("bigint"))

    def mask(k: int) -> int:
        m = sum(255 << (8 * i) for i in TRIPLES[k])
        return m - (1 << 64) if m >= 1 << 63 else m

    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(mask(k)).cast("bigint")) for k in range(len(TRIPLES))])
    lists = fps.select("fp", F.posexplode(keys).alias("k", "v"))
    left, right = lists.withColumnRenamed("fp", "a"), lists.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(mask(k)).cast("bigint")) == 0, F.lit(k)) for k in range(len(TRIPLES))])
    tally = sum(((byte(differ, i) == 0).cast("int") for i in range(8)), F.lit(0))
    pairs = left.join(right, ["k", "v"]).where(F.col("a") < F.col("b"))
    return pairs.where((first == F.col("k")) & (tally >= 8 - most) & (F.bit_count(differ) <= most)).select("a", "b")


def _groups(docs: DataFrame, doc_id: str, text: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash and fp of each row; fp, times and its component's least (no id, doc_id, text_hash))."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = with_fingerprint(narrow.withColumn("text_hash", F.xxhash64("text"))).select("doc_id", "text_hash", "fp")
    marked = written(marked, "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = marked.groupBy("fp").agg(F.min(place).alias("least"), F.count("*").alias("times"))
    parts = components(close_pairs(nodes.select("fp"), most))
    joined = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "times", "least", F.coalesce("component", "fp").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("smallest"))
    return marked, written(joined.join(smallest, "component").select("fp", "times", "smallest"), "groups")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed), component_id (smallest doc_id reachable over links).

    Null and empty texts have fingerprint 0 and link like any other; a null id takes part and gets its component's
    smallest id (null if there is none); repeated rows stay repeated; an empty table gives no rows; further columns
    of docs are not read. Equal fingerprints are one node, so a group of copies costs one row after a partial sum.
    """
    marked, groups = _groups(docs, doc_id, text, most)
    return salted_join(marked, groups, ["fp"], "times", "doc_id").select("doc_id", "fp", F.col("smallest.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """The row of docs with the smallest id of each near-duplicate group; all columns stay.

    Of several texts with that id the one with the least hash stays, of repeated rows one. A row without an id stays
    only where its whole group has none.
    """
    _, groups = _groups(docs, doc_id, text, most)
    key, own = free_names(docs, "id", "hash")
    found = groups.select(F.col("smallest.doc_id").alias(key), F.col("smallest.text_hash").alias(own)).distinct()
    kept = docs.join(found, F.col(doc_id).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text)) == F.col(own)), "left_semi")
    return kept.dropDuplicates([doc_id, text])
