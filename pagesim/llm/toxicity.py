"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index, with calibrated votes.

All terms of a text count: words, their first bytes for unseen forms of a stem, and what is found twice or thrice. A term's
weight is its TF-IDF times 1 + GAIN * sqrt(I), where I is the information that its presence gives on the label among the
examples; so examples are near for what tells labels apart, and any two texts still have a cosine over all their terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample
from .features import blocks, calibrated, column_texts, half

#: Words and beginnings fall into 2**BITS hash buckets, and a bucket found often enough for a level gives another term.
#: Lengths of word beginnings, counts of the levels, examples in a block, blocks visited together, terms with dense
#: blocks, texts compared side by side.
BITS, STEMS, LEVELS, BLOCK, VISITED, COMMON, TOGETHER, NEIGHBOURS, GAIN = 18, (4, 6), (2, 3), 32, 8, 1024, 128, 15, 50.0
TERMS = (1 + len(LEVELS)) << BITS
_MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\~`"
_INSIDE = np.array([chr(b) not in _MARKS and not bytes([b]).isspace() for b in range(256)])
#: Word hashes: sum of byte * PRIME ** place, then MIX; a beginning of n bytes adds n times SALT.
PRIME, MIX, SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


class _Hasher:
    """Powers of PRIME and its inverse as far as the longest block so far."""

    def __init__(self):
        self.up = self.down = np.empty(0, _U)

    def of(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(numbers of words, buckets) of the words raw[begin:end], then of their beginnings of each length."""
        if len(raw) > len(self.up):
            self.up, self.down = _powers(PRIME, len(raw)), _powers(pow(PRIME, -1, 1 << 64), len(raw))
        total = np.concatenate((np.zeros(1, _U), np.cumsum(raw * self.up[: len(raw)], dtype=_U)))
        out = []
        for k in (0, *STEMS):
            which = np.flatnonzero(end - begin > k) if k else np.arange(len(begin))
            first = begin[which]
            h = (total[first + k if k else end] - total[first]) * self.down[first] + _U(k * SALT % (1 << 64))
            h = (h ^ h >> _U(29)) * _U(MIX)
            out.append((which, (h >> _U(64 - BITS)).astype(np.int64)))
        return out


def terms(texts: list[str | None], known: _Hasher) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each whole text, lower-cased, terms ascending; a word is a run of neither white space nor marks."""
    raws = [(t or "").lower().encode() + b" " for t in texts]
    raw = np.frombuffer(b"".join(raws), np.uint8)
    inside = np.concatenate(([False], _INSIDE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    text = np.searchsorted(np.cumsum([len(r) for r in raws]), begin, "right") if len(begin) else begin
    code = np.sort(np.concatenate([text[which] << BITS | bucket for which, bucket in known.of(raw, begin, end)]))
    first = np.flatnonzero(np.concatenate((code[:1] == code[:1], code[1:] != code[:-1])))
    code, count = code[first], np.diff(np.append(first, len(code)))
    own, bucket = code >> BITS, code & ((1 << BITS) - 1)
    often = [count >= n for n in LEVELS]
    own = np.concatenate((own, *(own[x] for x in often)))
    term = np.concatenate((bucket, *(bucket[x] + (k << BITS) for k, x in enumerate(often, 1))))
    count = np.concatenate((count, *(count[x] for x in often)))
    order = np.argsort(own * TERMS + term, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(1, len(texts)))
    return list(zip(np.split(term[order], cuts), np.split(count[order], cuts))) if texts else []


def information(vectors: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each term's presence on the label, in nats, both labels weighing the same; vectors: the terms of each text."""
    share = []
    for label in (0, 1):
        found = [v for v, own in zip(vectors, y) if own == label]
        n = np.bincount(np.concatenate(found), minlength=TERMS) if found else np.zeros(TERMS)
        share.append((n + 0.5) / (len(found) + 1))
    mean = (share[0] + share[1]) / 2
    total = sum(a * np.log(a / m) for s in share for a, m in ((s, mean), (1 - s, 1 - mean))) / 2
    return np.maximum(total, 0)


@dataclass
class Index:
    """Postings of the examples' terms; the most common terms have dense blocks of BLOCK examples and the largest weight in
    each, for the others every posting is summed at once. Rows number the examples' terms, the most common first."""

    weight: np.ndarray  # of each term
    labels: np.ndarray
    ids: np.ndarray
    prior: float
    row: np.ndarray = field(default_factory=lambda: np.full(TERMS, -1, np.int32))  # of a term, -1: no example has it
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # row, example
    bounds: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # row, block
    begin: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of the postings of a row
    example: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.empty(0))
    scale: float = 1.0
    shift: float = 0.0

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights of length 1) of a text."""
        term, count = found
        w = (1 + np.log(count)) * self.weight[term]
        return term, w / max(1e-12, float(np.sqrt(w @ w)))

    def add(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        term = np.concatenate([np.empty(0, np.int64), *(t for t, _ in vectors)])
        value = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        known, n = np.unique(term, return_counts=True)
        self.row[known[np.argsort(-n, kind="stable")]] = np.arange(len(known))
        row = self.row[term]
        order = np.lexsort((example, row))
        row, example, value = row[order], example[order], value[order]
        common, n_blocks = min(COMMON, len(known)), -(-len(vectors) // BLOCK)
        self.dense = np.zeros((common, n_blocks * BLOCK))
        own = row < common
        self.dense[row[own], example[own]] = value[own]
        self.bounds = self.dense.reshape(common, n_blocks, BLOCK).max(axis=2) if self.dense.size else np.zeros((common, n_blocks))
        self.begin = np.searchsorted(row, np.arange(len(known) + 1))
        self.example, self.value = example.astype(np.int32), value

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (examples, cosines) of the k nearest with a cosine over 0; ties go to the earlier example.

        VISITED blocks at a time are visited, those of the largest bounds first, each for the texts whose bound in one of
        them is not below their k-th best cosine so far.
        """
        common, n = self.bounds.shape
        if not vectors or not n:
            return [(np.empty(0, np.int64), np.empty(0)) for _ in vectors]
        query, sums = np.zeros((len(vectors), common)), np.zeros((len(vectors), n * BLOCK))
        for i, (term, w) in enumerate(vectors):
            row = self.row[term]
            rare, often = row >= common, (row >= 0) & (row < common)
            query[i, row[often]] = w[often]
            begin = self.begin[row[rare]]
            size = self.begin[row[rare] + 1] - begin
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)
            sums[i] = np.bincount(self.example[at], np.repeat(w[rare], size) * self.value[at], minlength=n * BLOCK)
        bound = query @ self.bounds + sums.reshape(-1, n, BLOCK).max(axis=2)
        bound = np.maximum.reduceat(bound, np.arange(0, n, VISITED), axis=1)
        best = np.zeros((len(vectors), k))  # the largest cosines so far
        for c in np.argsort(-bound.mean(axis=0), kind="stable"):
            columns = slice(c * VISITED * BLOCK, (c + 1) * VISITED * BLOCK)
            some = np.flatnonzero((bound[:, c] > 0) & (bound[:, c] >= best.min(axis=1) - 1e-12))
            own = sums[some, columns] + query[some] @ self.dense[:, columns]
            sums[:, columns] = 0
            sums[some, columns] = own
            both = np.concatenate((best[some], own), axis=1)
            best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        out = []
        for total, least in zip(np.round(sums, 12), np.round(best.min(axis=1), 12)):
            at = np.flatnonzero((total >= least) & (total > 0))
            at = at[np.lexsort((at, -total[at]))[:k]]
            out.append((at, total[at]))
        return out

    def nearest_of(self, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The neighbours of texts with these terms and counts, TOGETHER at a time."""
        for k in range(0, len(found), TOGETHER):
            yield from self.nearest([self.vector(x) for x in found[k : k + TOGETHER]])

    def vote(self, examples: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the share of label 1 among the neighbours, each by 1 / distance, beside one vote of the prior."""
        weight = cosine / (1.05 - np.minimum(cosine, 1.0))
        share = (float((weight * self.labels[examples]).sum()) + self.prior) / (float(weight.sum()) + 1.0)
        share = min(max(share, 1e-4), 1 - 1e-4)
        return float(np.log(share / (1 - share)))

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * vote + self.shift, -50, 50))))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """(texts, texts that have each term) over all rows of docs; a task sends a count a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, total = _Hasher(), 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for texts in blocks(column_texts(batch, text), 1024):
                found = terms(texts, known)
                total += np.bincount(np.concatenate([t for t, _ in found]), minlength=TERMS)
                n += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n))], names=["term", "n"])

    got = docs.select(text).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # TERMS rows at most
    df = np.zeros(TERMS + 1, np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()  # the last one is the count of texts
    return int(df[-1]), df[:-1]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 2000) -> Index:
    """Index of labelled examples from a sample bounded by per_label rows of each label (0 and 1; others teach nothing).

    Half of the sample, by hash of the id, is indexed; the other half calibrates the votes, each row weighing as many
    labelled rows as it stands for, so that scores follow the labels' true shares. Document frequencies cover all rows of
    docs. Copies of a text count once. Rows without id or label teach nothing; an empty sample gives an even score.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    true = dict(map(tuple, known.groupBy("y").count().collect()))
    sample = F.broadcast(labelled_sample(known, "y", per_label, ["doc_id"]))  # 2 * per_label ids
    every = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = every.join(sample, "doc_id").select("doc_id", half(F.col("doc_id")).alias("part"), "y", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hasher()
        for batch in batches:
            found = [x for texts in blocks(column_texts(batch, "text"), 1024) for x in terms(texts, known)]
            offsets = pa.array(np.cumsum([0, *(len(b) for b, _ in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in found] or [np.empty(0)]), pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], names=["doc_id", "part", "y", "h", "bucket", "n"])

    got = rows.mapInArrow(run, "doc_id bigint, part int, y int, h bigint, bucket array<int>, n array<int>").toArrow()  # 2 * per_label lists
    got = got.sort_by([("doc_id", "ascending"), ("h", "ascending")])
    first: dict[int, int] = {}
    for k, h in enumerate(got.column("h").to_pylist()):
        first.setdefault(h, k)
    got = got.take(pa.array(list(first.values()), pa.int64()))
    ids, part, y = (got.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "part", "y"))
    own = [(np.asarray(b.values, np.int64), np.asarray(c.values, np.int64)) for b, c in zip(got.column("bucket"), got.column("n"))]
    n, df = document_frequencies(every)
    indexed = np.flatnonzero(part == 0)
    gain = 1 + GAIN * np.sqrt(information([own[k][0] for k in indexed], y[indexed])) if len(indexed) else 1.0
    index = Index((np.log((1 + n) / (1 + df)) + 1) * gain, y[indexed], ids[indexed], float(y.mean()) if len(y) else 0.5)
    index.add([index.vector(own[k]) for k in indexed])
    rest = np.flatnonzero(part == 1)
    votes = np.array([index.vote(*x) for x in index.nearest_of([own[k] for k in rest])])
    stands = np.array([true.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)])
    index.scale, index.shift = calibrated(votes, y[rest], stands[y[rest]])
    return index


def score(docs: DataFrame, index: Index, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (probability of label 1), predicted (1 if score >= threshold) and evidence (example ids, cosines).

    Null and empty texts have no terms, so no neighbours, and get the score of the prior's vote. Whole texts are read;
    rows, repeated ones too, and other columns stay as they are; columns already called like a result are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)  # 2 * per_label sparse rows at most
    kind = T.ArrayType(T.StructType([T.StructField("example", T.LongType()), T.StructField("cosine", T.DoubleType())]))
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", kind)]
    source = docs.drop(*(f.name for f in added if f.name != text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = held.value, _Hasher()
        for batch in batches:
            p, found = [], []
            for texts in blocks(column_texts(batch, text), TOGETHER):
                for at, cosine in own.nearest_of(terms(texts, known)):
                    p.append(own.probability(own.vote(at, cosine)))
                    found.append((own.ids[at], cosine))
            offsets = pa.array(np.cumsum([0, *(len(c) for _, c in found)]), pa.int32())
            flat = [np.concatenate([x[k] for x in found] or [np.empty(0)]) for k in (0, 1)]
            pairs = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.float64))], names=["example", "cosine"])
            p = np.array(p, np.float64)
            new = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.ListArray.from_arrays(offsets, pairs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in added)])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *added]))
