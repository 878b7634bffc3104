"""Language identification by nearest centroid: TF-IDF vectors of hashed byte trigrams, several centroids a language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample
from .features import blocks, column_texts, counts, doc_ngrams

BITS, NGRAM = 13, 3
_LETTER = regex.compile(r"\p{L}").search
_CLEAN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def _counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [b" " + t.lower().encode().translate(_CLEAN) + b" " if t else b"" for t in texts]
    return counts(*doc_ngrams(raw, NGRAM, BITS), len(texts), BITS)


def _vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, one a row; a text without trigrams has zeros."""
    doc, bucket, count = _counted(texts)
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    out[doc, bucket] = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, 1e-12)[:, None]


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str] = field(default_factory=list)  # of each centroid
    least: list[float] = field(default_factory=list)  # for each centroid the similarity below which a text is rejected


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means that begins with vectors far from those chosen so far; the farthest twentieth are odd ones."""
    chosen = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(x[np.argsort(np.max(x @ np.array(chosen).T, axis=1), kind="stable")[len(x) // 20]])
    centres = np.array(chosen)
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[nearest == j].sum(axis=0) for j in range(len(centres)) if (nearest == j).any()])
        centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]
    return centres


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """(texts, texts that have each bucket) over all rows: one vector of fixed size a task, summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + (1 << BITS), np.int64)
        for batch in batches:
            for texts in blocks(column_texts(batch, text)):
                total[0] += len(texts)
                total[1:] += np.bincount(_counted(texts)[1], minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    found = docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(1 + (1 << BITS), np.int64)
    for bucket, n in found:
        total[bucket] = n
    return int(total[0]), total[1:]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300, centroids: int = 4, slack: float = 0.6) -> Model:
    """Centroids from rows with a language; rows without language or text teach nothing.

    Document frequencies cover all rows; the centroids come from a sample bounded by per_language different texts a
    language, told by the least hashes, of which a fifth is held back. A text is rejected if its similarity to the nearest
    centroid is below `slack` times the least that a text held back has with a centroid of its own language.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    n, df = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes = batch.column(batch.schema.get_field_index("lang")).to_pylist(), batch.column(batch.schema.get_field_index("h"))
            done = 0
            for texts in blocks(column_texts(batch, "text")):
                doc, bucket, count = _counted(texts)
                offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, pa.int32())) for x in (bucket, count)]
                yield pa.RecordBatch.from_arrays([pa.array(langs[done : done + len(texts)], pa.string()), hashes.slice(done, len(texts)), *lists], names=["lang", "h", "bucket", "n"])
                done += len(texts)

    hashed = rows.withColumn("h", F.xxhash64("text"))
    few = F.broadcast(labelled_sample(hashed.select("lang", "h"), "lang", per_language, ["h"]))  # per_language rows a language
    texts = hashed.join(few, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    sample = texts.select("lang", "h", "text").mapInArrow(run, "lang string, h bigint, bucket array<int>, n array<int>").collect()
    by: dict[str, list[np.ndarray]] = {}
    for language, _, bucket, count in sorted(sample, key=lambda r: r.h):
        x = np.zeros(1 << BITS, np.float32)
        x[bucket] = (1 + np.log(np.array(count, np.float32))) * idf[bucket]
        if norm := float(np.linalg.norm(x)):
            by.setdefault(language, []).append(x / norm)
    model = Model(idf, np.zeros((0, 1 << BITS), np.float32))
    for language in sorted(by):
        x = np.array(by.pop(language))
        back = np.arange(len(x)) % 5 == 4 if len(x) >= 10 else np.zeros(len(x), bool)
        centres = _cluster(x[~back], centroids)
        near = (x[back] if back.any() else x) @ centres.T
        model.centroids = np.concatenate((model.centroids, centres))
        model.languages += [language] * len(centres)
        model.least += [slack * float(near.max(axis=1).min())] * len(centres)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred (nearest centroid's language), score (its cosine, 0 to 1) and rejected.

    A text that is null or has no letter is `und` with score 0 and rejected, as is every text if nothing was learned.
    Whole texts count, whatever their length; rows, repeated ones too, and other columns stay as they are; columns
    already called lang_pred, score or rejected are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen KB for each learned centroid
    kept = docs.drop("lang_pred", "score", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for texts in blocks(column_texts(batch, text)):
                if len(m.languages):
                    near = _vectors(texts, m.idf) @ m.centroids.T
                    best = np.argmax(near, axis=1)
                    top = near[np.arange(len(texts)), best]
                for k, t in enumerate(texts):
                    if t and len(m.languages) and _LETTER(t):
                        langs.append(m.languages[best[k]])
                        scores.append(min(1.0, max(0.0, float(top[k]))))
                        rejected.append(bool(top[k] < m.least[best[k]]))
                    else:
                        langs.append("und")
                        scores.append(0.0)
                        rejected.append(True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))
