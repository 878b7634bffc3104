"""Hashed n-gram counts of whole texts in numpy blocks, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 1_500_000


def hashed_ngrams(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram (n <= 4) of bytes that begins at each place; the last n - 1 places are left out."""
    if len(raw) < n:
        return np.empty(0, np.int64)
    code = np.zeros(len(raw) - n + 1, np.uint32)
    for k in range(n):
        code |= raw[k : len(raw) - n + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(2654435761)
    code ^= code >> np.uint32(15)
    code *= np.uint32(2246822519)
    return (code >> np.uint32(32 - bits)).astype(np.int64)


def doc_ngrams(texts: list[bytes], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, bucket) of every n-gram; none reaches from one text into the next."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    buckets = hashed_ngrams(raw, n, bits)
    doc = np.repeat(np.arange(len(texts)), sizes)
    if not len(buckets):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = doc[: len(buckets)] == doc[n - 1 : n - 1 + len(buckets)]
    return doc[: len(buckets)][inside], buckets[inside]


def counts(doc: np.ndarray, bucket: np.ndarray, docs: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts: (text, bucket, count), ordered by text and bucket."""
    dense = np.bincount((doc << bits) + bucket, minlength=docs << bits)
    at = np.flatnonzero(dense)
    return at >> bits, at & ((1 << bits) - 1), dense[at]


def blocks(texts: Iterable[str | bytes | None], docs: int = 96, most: int = BLOCK_BYTES) -> Iterator[list]:
    """Runs of texts of about `most` characters or bytes together (or one longer text), `docs` at most."""
    held, block = 0, []
    for x in texts:
        block.append(x)
        held += len(x) if x else 0
        if held >= most or len(block) >= docs:
            yield block
            held, block = 0, []
    if block:
        yield block


def column_texts(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    return (x.as_py() for x in batch.column(batch.schema.get_field_index(name)))


def column_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """The texts in UTF-8, as they are held."""
    return (x.as_py() for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()))


def half(key: Column) -> Column:
    """0 or 1 for each row, by hash."""
    return F.pmod(F.xxhash64(key, F.lit("half")), F.lit(2)).cast("int")


def calibrated(raw: np.ndarray, y: np.ndarray, stands: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve from raw scores to probabilities, by Newton steps; stands: rows that each stands for."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    weight = stands / stands.mean()
    x, ab = np.stack((raw, np.ones(len(raw)))), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -50, 50)))
        ab -= np.clip(np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (weight * (p - target))), -1, 1)
    return float(ab[0]), float(ab[1])
