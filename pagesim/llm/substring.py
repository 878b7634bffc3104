"""Substring dedup by content-defined chunking: least gear hashes cut texts, and chunks are told apart by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, free_names, salted_join, written

#: A cut is a place whose hash, of the last 8 bytes, is the least of the AROUND places on either side, so nothing but the
#: bytes around it matters. Where texts repeat with a short period all its least places are cuts, MIN bytes apart or more.
AROUND, MIN = 16, 16
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of a text, in ascending order; the last is its length. An empty text has none."""
    if not raw:
        return []
    h = GEAR[np.frombuffer(raw, np.uint8)]
    for step in (1, 2, 4):  # after these, h[i] = sum of gear[raw[i - j]] << j over the 8 bytes up to i
        if len(h) > step:
            shifted = h[:-step] << np.uint32(step)
            h[step:] += shifted
    least = np.pad(h, AROUND, constant_values=np.uint32(0xFFFFFFFF))
    for step in (1, 2, 4, 8, 16):  # after these, least[i] is that of 32 places from i
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[:-1], least[1:])
    ends, begin = [], 0
    for at in (np.flatnonzero(h == least) + 1).tolist():
        if at - begin >= MIN:
            ends.append(at)
            begin = at
    if begin < len(raw):
        ends.append(len(raw))
    return ends


def _digests(raw: bytes) -> list[int]:
    digest, begin, out = xxhash.xxh64_intdigest, 0, []
    for end in cuts(raw):
        out.append(digest(raw[begin:end]))
        begin = end
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and `digests` (signed 64-bit) of the chunks of each whole text, in order; docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(_digests((x.as_py() or "").encode()), np.uint64).view(np.int64) for x in batch.column(2)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))], names=["doc_id", "text_hash", "digests"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id bigint, text_hash bigint, digests array<bigint>")


def _runs(places: list[int], ends: list[int], least: int) -> list[tuple[int, int]]:
    """Spans of adjacent chunks among `places` that hold `least` bytes or more together."""
    spans: list[list[int]] = []
    for k in sorted(set(places)):
        begin = ends[k - 1] if k else 0
        if spans and spans[-1][1] == begin:
            spans[-1][1] = ends[k]
        else:
            spans.append([begin, ends[k]])
    return [(a, b) for a, b in spans if b - a >= least]


def _without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a character that a span holds only in part stays."""
    kept, begin = [], 0
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(raw[begin:a])
        begin = b
    return b"".join([*kept, raw[begin:]]).decode()


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 80, out: str = "deduped") -> DataFrame:
    """docs with shared_spans, removed_spans (byte ranges of the UTF-8 text) and `out`, the text without removed_spans.

    A chunk is shared if a document with another id has it; it is removed from every document but the one with the
    least id. Spans are runs of such chunks of `least` bytes or more, so shifts by insertions and chance matches of
    single chunks do not matter. A chunk that repeats under one id only is left alone, also in different texts with that
    id. Null texts give null and no spans, empty ones no spans; a null id counts as the lowest; repeated rows are treated
    alike; other columns stay as they are, those called like a result are replaced.
    """
    lowest = F.lit(-(1 << 63)).cast("bigint")
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), lowest).alias("doc_id"), F.col(text).alias("text"))
    cut = written(chunks(keyed).distinct(), "chunks")
    places = cut.select("doc_id", "text_hash", F.posexplode("digests").alias("k", "digest"))
    # only sums of a fixed size meet for a digest, however many documents have it
    first = written(places.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("times")).where("first < last").drop("last"), "shared")
    met = salted_join(places, first, ["digest"], "times", "text_hash")
    later = F.when(F.col("doc_id") > F.col("first"), F.col("k"))
    found = written(met.groupBy("doc_id", "text_hash").agg(F.collect_list("k").alias("shared"), F.collect_list(later).alias("later")), "found")
    dropped(cut, first)
    source = docs.drop("shared_spans", "removed_spans", out)
    key, own, marked, gone = free_names(source, "id", "hash", "shared", "later")
    same = (F.coalesce(F.col(doc_id).cast("bigint"), lowest) == F.col(key)) & (F.xxhash64(F.col(text)) == F.col(own))
    joined = source.join(found.toDF(key, own, marked, gone), same, "left").drop(key, own)
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    added = [T.StructField("shared_spans", span), T.StructField("removed_spans", span), T.StructField(out, T.StringType())]
    arrow = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            shared, removed, texts = [], [], []
            for t, s, x in zip(*(batch.column(names.index(c)) for c in (text, marked, gone))):
                t, s, x = t.as_py(), s.as_py() or [], x.as_py() or []
                if not t or not s:
                    spans: list[list[tuple[int, int]]] = [[], []]
                else:
                    raw = t.encode()
                    ends = cuts(raw)
                    spans = [_runs([k for k in ks if k < len(ends)], ends, least) for ks in (s, x)]
                    t = _without(raw, spans[1]) if spans[1] else t
                shared.append([{"begin": a, "end": b} for a, b in spans[0]])
                removed.append([{"begin": a, "end": b} for a, b in spans[1]])
                texts.append(t)
            keep = [k for k, c in enumerate(names) if c not in (marked, gone)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(shared, arrow), pa.array(removed, arrow), pa.array(texts, pa.string())], names=[*(names[k] for k in keep), *(f.name for f in added)])

    return joined.mapInArrow(run, T.StructType([*source.schema.fields, *added]))
