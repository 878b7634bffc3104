"""Quality rules: exact counts of repetition and symbols, and logistic regression on hashed words and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample
from .features import blocks, calibrated, column_texts, counts, doc_ngrams, half

WORD_BITS, GRAM_BITS, NGRAM, WINDOW = 12, 13, 3, 8
FEATURES = (1 << WORD_BITS) + (1 << GRAM_BITS)
_SPACES, _SYMBOLS = "\t\n\v\f\r ", "#*$%&|<>"
_MIX = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
REMEMBERED = 1_000_000


class _Hashes(dict):
    """64-bit hash of each word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window += hashes[k : k + n] * _MIX[k]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if all((hashes[a + k] == hashes[b + k]).all() for k in range(WINDOW)):
        at = np.unique(np.concatenate((a, b)))
    else:  # different windows of one sum
        found: dict[bytes, list[int]] = {}
        for k in range(n):
            found.setdefault(hashes[k : k + WINDOW].tobytes(), []).append(k)
        at = np.array([k for places in found.values() if len(places) > 1 for k in places], np.int64)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str | None, hashes: np.ndarray) -> tuple[int, ...]:
    """The counts named COUNTS; hashes: those of the text's words."""
    if not text:
        return (0,) * len(COUNTS)
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(_SPACES)]
        dup = len(lines) - len(set(lines))
    return len(hashes), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), dup, repeated_words(hashes)


def _sparse(raw: list[bytes], hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value): 1 + log of the counts of hashed words and byte n-grams, each text of length 1."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    words = counts(np.repeat(np.arange(len(raw)), sizes), (every >> np.uint64(64 - WORD_BITS)).astype(np.int64), len(raw), WORD_BITS)
    grams = counts(*doc_ngrams(raw, NGRAM, GRAM_BITS), len(raw), GRAM_BITS)
    doc = np.concatenate((words[0], grams[0]))
    value = 1 + np.log(np.concatenate((words[2], grams[2])))
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(raw)))
    return doc, np.concatenate((words[1], grams[1] + (1 << WORD_BITS))), value / np.maximum(norm, 1e-12)[doc]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: float = 1.0  # of the calibration
    shift: float = 0.0

    def raw(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        return np.bincount(doc, value * self.weights[feature], minlength=docs) + self.bias

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -50, 50)))


def _fit(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> Model:
    """Logistic regression with both classes weighing the same, by Adam over all rows at once."""
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    theta, m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for step in range(1, rounds + 1):
        raw = np.bincount(doc, value * theta[feature], minlength=len(y)) + theta[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - y)
        grad = np.append(np.bincount(feature, value * error[doc], minlength=FEATURES), error.sum())
        grad[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return Model(theta[:-1], float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 1500) -> Model:
    """Model of P(label = 1) from a sample bounded by per_label rows of each label (0 and 1; others teach nothing).

    The sample is drawn from the narrow label table, so only its few rows meet the texts. Half of it, by hash of the
    id, fits the weights, the other half calibrates, each row weighing as many labelled rows as it stands for. Without rows of both labels every text gets the share of ones.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    true = dict(map(tuple, known.groupBy("y").count().collect()))
    sample = labelled_sample(known, "y", per_label, ["doc_id"])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")  # 2 * per_label rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            ids, ys = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "y"))
            done = 0
            for texts in blocks(column_texts(batch, "text")):
                raw = [(t or "").encode() for t in texts]
                doc, feature, value = _sparse(raw, [known.of(r.split()) for r in raw])
                order = np.argsort(doc, kind="stable")
                offsets = pa.array(np.searchsorted(doc[order], np.arange(len(texts) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], kind)) for x, kind in ((feature, pa.int32()), (value.astype(np.float32), pa.float32()))]
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(texts)), ys.slice(done, len(texts)), *lists], names=["part", "y", "feature", "value"])
                done += len(texts)

    got = rows.select(half(F.col("doc_id")).alias("part"), "y", "text").mapInArrow(run, "part int, y int, feature array<int>, value array<float>").toArrow()
    part, y = (got.column(c).to_numpy() for c in ("part", "y"))
    sizes = np.array([len(x) for x in got.column("feature")], np.int64)
    flat = [np.concatenate([c.flatten().to_numpy() for c in got.column(k).chunks]) if got.num_rows else np.empty(0) for k in ("feature", "value")]
    doc = np.repeat(np.arange(len(y)), sizes)
    feature, value = flat[0].astype(np.int64), flat[1].astype(np.float64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(FEATURES), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    inside = part[doc] == 0
    fit_rows = np.cumsum(part == 0) - 1
    model = _fit(fit_rows[doc[inside]], feature[inside], value[inside], y[part == 0])
    raw, back = model.raw(doc, feature, value, len(y)), part == 1
    stands = np.array([true.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)])
    model.scale, model.shift = calibrated(raw[back], y[back], stands[y[back]])
    return model


def judge(docs: DataFrame, model: Model, text: str = "text", least_words: int = 20, most_repeated: int = 30, threshold: float = 0.3) -> DataFrame:
    """docs with the counts named COUNTS, base_failed, quality (calibrated probability) and kept.

    base_failed: fewer than least_words words, or over most_repeated percent of them in repeated windows. kept: not
    base_failed and quality >= threshold. Null and empty texts have zero counts and fail. Whole texts are read; rows,
    repeated ones too, and other columns stay as they are; columns already called like a result are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES doubles
    added = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    source = docs.drop(*(f.name for f in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            quality = [np.empty(0)]
            for texts in blocks(column_texts(batch, text)):
                raw = [(t or "").encode() for t in texts]
                hashes = [known.of(r.split()) for r in raw]
                rows += map(base_counts, texts, hashes)
                quality.append(held.value.probability(held.value.raw(*_sparse(raw, hashes), len(raw))))
            table = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            q = np.concatenate(quality)
            failed = (table[:, 0] < least_words) | (100 * table[:, 4] > most_repeated * table[:, 0])
            new = [*(pa.array(c) for c in table.T), pa.array(failed), pa.array(q), pa.array(~failed & (q >= threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in added)])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *added]))
