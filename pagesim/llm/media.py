"""Media columns: chroma audio fingerprints, and recordings aligned by offset histograms and bit errors."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Samples of a frame and between frames at RATE samples a second; frames that a packed integer looks at.
RATE, FRAME, HOP, REACH = 4000, 512, 128, 16
#: A key of the index is one byte of an integer and the same byte of those so far behind it; each of the four bytes has keys.
AHEAD, BANDS = (8, 16), (0, 8, 16, 24)
#: Integers of a block of classes, about; votes that a task holds at once.
BLOCK, VOTES = 1 << 19, 1 << 18
#: Votes are first counted in that many slots (a power of 2).
SLOT_BITS = 19
LOWEST, HIGHEST = 100.0, 1900.0
#: For each filter its kind, first pitch class, pitch classes and frames. Kinds compare 0: lower with
#: upper pitch classes, 1: earlier with later frames, 2: the two diagonals of quarters, 3: the middle with both sides.
FILTERS = [
    (0, 0, 4, 3), (0, 4, 4, 5), (0, 8, 4, 7), (0, 2, 8, 9), (1, 0, 3, 4), (1, 3, 3, 6), (1, 6, 3, 8), (1, 9, 3, 12),
    (2, 0, 6, 6), (2, 6, 6, 8), (2, 3, 6, 12), (2, 0, 12, 16), (3, 0, 3, 9), (3, 4, 3, 12), (3, 8, 3, 15), (3, 0, 12, 6),
]
#: A filter's value falls into one of four steps, told by two bits of which neighbours differ in one.
STEPS = (-0.35, 0.0, 0.35)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def _class_weights(rate: int) -> np.ndarray:
    """Share of each frequency of a frame's spectrum in the twelve pitch classes."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hz), 12), np.float32)
    for k in np.flatnonzero((hz >= LOWEST) & (hz <= HIGHEST)):
        out[k, int(round(12 * np.log2(hz[k] / 440.0))) % 12] = 1
    return out


def samples(audio: bytes | None) -> tuple[np.ndarray, int]:
    """(samples of all channels' mean from -1 to 1, samples a second) of a WAV file with 16 bits; none if it is not one."""
    try:
        with wave.open(io.BytesIO(audio or b"")) as w:
            if w.getsampwidth() != 2:
                return np.empty(0, np.float32), RATE
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
            return x.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError):
        return np.empty(0, np.float32), RATE


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames by pitch classes, each frame of sum 1 (even where it is silent)."""
    if len(x) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    classes = power.astype(np.float32) @ _class_weights(rate) + 1e-6
    return classes / classes.sum(axis=1, keepdims=True)


def fingerprint(audio: bytes | None) -> np.ndarray:
    """A packed integer (32 bits, signed) for each run of REACH frames; none for audio shorter than that."""
    image = chroma(*samples(audio))
    n = len(image) - REACH + 1
    if n < 1:
        return np.empty(0, np.int32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = np.cumsum(np.cumsum(image, axis=0), axis=1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return total[t1 : t1 + n, c1] - total[t0 : t0 + n, c1] - total[t1 : t1 + n, c0] + total[t0 : t0 + n, c0]

    packed = np.zeros(n, np.uint32)
    for kind, c0, height, width in FILTERS:
        c1, cm, tm = c0 + height, c0 + height // 2, width // 2
        if kind == 0:
            a, b = area(0, width, c0, cm), area(0, width, cm, c1)
        elif kind == 1:
            a, b = area(0, tm, c0, c1), area(tm, width, c0, c1)
        elif kind == 2:
            a, b = area(0, tm, c0, cm) + area(tm, width, cm, c1), area(0, tm, cm, c1) + area(tm, width, c0, cm)
        else:
            third = width // 3
            a = 2 * area(third, 2 * third, c0, c1)
            b = area(0, third, c0, c1) + area(2 * third, 3 * third, c0, c1)
        value = np.log((1e-3 + np.maximum(a, 0)) / (1e-3 + np.maximum(b, 0)))
        packed = packed << np.uint32(2) | GRAY[np.digitize(value, STEPS)]
    return packed.view(np.int32)


def with_fingerprint(media: DataFrame, audio: str = "audio", out: str = "fingerprint") -> DataFrame:
    """media without the audio column, with `out` (array of int). Null, short and unreadable audio has an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(audio)
            found = [fingerprint(x.as_py()) for x in batch.column(at)]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            keep = [k for k, c in enumerate(batch.schema.names) if c not in (audio, out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=[*(batch.schema.names[k] for k in keep), out])

    kept = [f for f in media.schema.fields if f.name not in (audio, out)]
    return media.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def _keys(flat: np.ndarray, owner: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in flat, keys) of one band; owner tells the recordings apart."""
    reach = AHEAD[-1]
    at = np.flatnonzero(owner[:-reach] == owner[reach:]) if len(flat) > reach else np.empty(0, np.int64)
    key = np.zeros(len(at), np.uint32)
    for k in (0, *AHEAD):
        key = key << np.uint32(8) | flat[at + k] >> np.uint32(band) & np.uint32(255)
    return at, key


def _counted(code: np.ndarray, votes: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, votes) summed by code (None: one vote each); codes of fewer than `least` votes may be missing."""
    if least and len(code):
        slot = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        some = np.bincount(slot, votes, 1 << SLOT_BITS)[slot] >= least  # most codes are alone
        code, votes = code[some], None if votes is None else votes[some]
    if votes is None:
        return np.unique(code, return_counts=True)
    code, back = np.unique(code, return_inverse=True)
    return code, np.bincount(back, votes, len(code)).astype(np.int64)


def _offsets(flat: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, least_votes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, offset) with least_votes or more, of recordings a < b of which one is in `left`, the other in `right`.

    These are masks: one and the same, or two that share no recording.
    """
    n, pad = len(size), int(size.max())
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(flat)) - start[owner]
    room = 2 * pad + 1  # of offsets
    from_left, from_right = owner * (n * room) - place + pad, owner * room + place  # their sum is a vote's code
    own, other = [], []  # postings: of left their places, of right where their equals are
    lists = []
    for band in BANDS:
        at, key = _keys(flat, owner, band)
        l, r = left[owner[at]], right[owner[at]]
        order = np.argsort(key[r])
        there = key[r][order]
        asked = order if left is right else np.argsort(key[l])
        sought = there if left is right else key[l][asked]  # in order, so that the search stays where it was
        own.append(at[l][asked])
        other.append(np.stack((np.searchsorted(there, sought, "left"), np.searchsorted(there, sought, "right"))) + sum(map(len, lists)))
        lists.append(from_right[at[r][order]])
    own, (begin, end), lists = np.concatenate(own), np.concatenate(other, axis=1), np.concatenate(lists)
    met = np.flatnonzero(end > begin)
    met = met[np.argsort(own[met])]
    own, begin, count = own[met], begin[met], (end - begin)[met]
    owners, sums = owner[own], from_left[own]
    total = np.concatenate(([0], np.cumsum(count)))
    code, votes, k = np.empty(0, np.int64), np.empty(0, np.int64), 0
    while k < len(own):
        m = max(k + 1, int(np.searchsorted(total, total[k] + VOTES, "right")) - 1)
        if m < len(own):
            whole = int(np.searchsorted(owners, owners[m]))
            m = whole if whole > k else m
        each = count[k:m]
        there = lists[np.arange(total[m] - total[k]) - np.repeat(total[k:m] - total[k] - begin[k:m], each)]
        more = np.repeat(sums[k:m], each) + there
        if left is right:
            more = more[there >= np.repeat((owners[k:m] + 1) * room, each)]  # of a later recording
        if not len(code) and (m == len(own) or owners[m] != owners[m - 1]):
            enough, counted = _counted(more, None, least_votes)
        else:  # a recording with more votes than fit: its last part's go on
            bound = np.iinfo(np.int64).max if m == len(own) else owners[m] * n * room
            over, later = more < bound, code >= bound
            enough, counted = _counted(np.concatenate((code[~later], more[over])), np.concatenate((votes[~later], np.ones(int(over.sum()), np.int64))), least_votes)
            code, votes = _counted(np.concatenate((code[later], more[~over])), np.concatenate((votes[later], np.ones(int((~over).sum()), np.int64))), 0)
        enough = enough[counted >= least_votes]
        k = m
        a, b, offset = enough // room // n, enough // room % n, enough % room - pad
        yield np.minimum(a, b), np.maximum(a, b), np.where(a < b, offset, -offset)


def _links(flat: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, offset: np.ndarray, least_overlap: int, most_error: float) -> tuple[np.ndarray, ...]:
    """(a, b, offset, bit_error) of the overlaps that link."""
    start = np.cumsum(size) - size
    begin, overlap = np.maximum(0, -offset), np.minimum(size[a], size[b] - offset) - np.maximum(0, -offset)
    x, y = start[a] + begin, start[b] + begin + offset
    long = np.flatnonzero(overlap >= least_overlap)
    wrong = np.zeros(len(a))
    total = np.concatenate(([0], np.cumsum(overlap[long])))
    k = 0
    while k < len(long):
        m = max(k + 1, int(np.searchsorted(total, total[k] + VOTES, "right")) - 1)
        w = overlap[long[k:m]]
        within = np.arange(total[m] - total[k]) - np.repeat(total[k:m] - total[k], w)
        bits = np.bitwise_count(flat[np.repeat(x[long[k:m]], w) + within] ^ flat[np.repeat(y[long[k:m]], w) + within])
        wrong[long[k:m]] = np.add.reduceat(bits, total[k:m] - total[k], dtype=np.int64)
        k = m
    error = wrong[long] / (overlap[long] * 32.0)
    near = long[error <= most_error]
    return a[near], b[near], offset[near], error[error <= most_error]


def align(marked: DataFrame, media_id: str = "media_id", least_votes: int = 2, least_overlap: int = 24, most_error: float = 0.25) -> DataFrame:
    """One row per row of marked (media_id, fingerprint): class_id, n_links, best_match, offset, bit_error.

    Recordings with equal fingerprints are one class, called by its smallest id, and one row from there on. Places of two
    classes whose keys agree vote for the offset between them, each place and each of the four BANDS. All offsets with
    least_votes are tried; one links the classes if they overlap in least_overlap integers of which at most most_error
    of the bits differ, and the one with the fewest errors counts (ties: the smallest shift, then the smallest offset).
    n_links counts linked classes, best_match is the one with the fewest errors (ties: the smallest id). Empty
    fingerprints link with nothing; a null id takes part if its class has an id.

    Classes are dealt into blocks and each pair of blocks is one task, so votes are counted and tried where they arise,
    and no common key becomes a hot one; a task gives one row for each class that links, with their number and its best. A link whose bits differ too evenly for two keys to agree is not found.
    """
    rows = marked.select(F.col(media_id).alias("media_id"), "fingerprint", F.xxhash64("fingerprint").alias("print"))
    classes = written(rows.groupBy("print").agg(F.min("media_id").alias("class_id"), F.first("fingerprint").alias("fingerprint")), "classes")
    once = classes.where(F.col("class_id").isNotNull() & (F.size("fingerprint") > 0)).select("class_id", "fingerprint")
    blocks = max(1, -(-(once.agg(F.sum(F.size("fingerprint"))).first()[0] or 0) // BLOCK))
    dealt = once.withColumn("own", F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class_id", "fingerprint")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("class_id").combine_chunks()
        prints = table.column("fingerprint").combine_chunks()
        flat, size = np.asarray(prints.flatten()).view(np.uint32), np.asarray(prints.value_lengths()).astype(np.int64)
        own, i, j = np.asarray(table.column("own")), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = own == i
        found = [_links(flat, size, *x, least_overlap, most_error) for x in _offsets(flat, size, left, left if i == j else own == j, least_votes)]
        a, b, offset, error = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
        order = np.lexsort((offset, np.abs(offset), error, b, a))
        a, b, offset, error = a[order], b[order], offset[order], error[order]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
        a, b, offset, error = a[first], b[first], offset[first], error[first]
        one, other = np.concatenate((a, b)), np.concatenate((b, a))  # each link for both; a class's best is its first
        offset, error = np.concatenate((offset, -offset)), np.concatenate((error, error))
        order = np.lexsort((offset, other, error, one))
        one, other, offset, error = one[order], other[order], offset[order], error[order]
        begin = np.flatnonzero(np.concatenate((one[:1] == one[:1], one[1:] != one[:-1])))
        n = np.diff(np.append(begin, len(one)))
        ids = table.column("class_id").combine_chunks()
        return pa.table({"class_id": ids.take(pa.array(one[begin], pa.int64())), "n": pa.array(n, pa.int64()), "bit_error": pa.array(error[begin], pa.float64()), "other": ids.take(pa.array(other[begin], pa.int64())), "offset": pa.array(offset[begin], pa.int32())})

    kind = once.schema["class_id"].dataType
    schema = T.StructType([T.StructField("class_id", kind), T.StructField("n", T.LongType()), T.StructField("bit_error", T.DoubleType()), T.StructField("other", kind), T.StructField("offset", T.IntegerType())])
    ends = written(dealt.groupBy("i", "j").applyInArrow(run, schema), "links")
    own = ends.groupBy("class_id").agg(F.sum("n").alias("n_links"), F.min(F.struct("bit_error", "other", "offset")).alias("x"))
    known = classes.select("print", "class_id").join(own, "class_id", "left")
    joined = rows.join(known, "print", "left")
    return joined.select("media_id", F.size("fingerprint").alias("n_prints"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("x.other").alias("best_match"), F.col("x.offset").alias("offset"), F.col("x.bit_error").alias("bit_error"))
