"""Language-model scoring: unigram base and a gated recurrent network in numpy with a class-factored softmax.

Words are counted over all training texts. The most frequent ones are the network's vocabulary, in classes of CLASS; all
others fall into one of REST classes by their first letters, where a word has its add-one share of the counts. A text's
probability is the product over its words and its end of P(class | state) P(word | class, state), the state carried from
window to window from the text's first word to its end. Training goes over every text in the same way: texts are laid one
after the other into lanes, each window of SPAN words is trained by backpropagation through its steps, and the state at
its end begins the next; a text begins with the zero state.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, free_names, written
from .features import blocks, column_bytes

#: Hidden units, words in a class, classes of frequent words at most, classes of other words, words kept with their
#: counts in each task at most (those of the highest counts; a join finds the others').
HIDDEN, CLASS, CLASSES, REST, HEAD = 16, 64, 48, 16, 300_000
#: Words of a training window, rounds of averaging (each has its share of the texts), lanes of training at most and of
#: scoring, steps scored at once, tokens of the same class side by side, tokens for a whole training step.
SPAN, ROUNDS, TRAIN_LANES, LANES, STEPS, TOGETHER, FULL = 48, 3, 256, 768, 64, 32, 3072
#: Characters whose words are held at once, tokens that wait for the net.
BLOCK_CHARS, WAITING = 3_000_000, 6_000_000
END = "\n"  # no word has it
_FLUSH = 400_000


def _rest(word: bytes) -> int:
    return zlib.crc32(word[:3]) % REST


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n over all texts of docs, the end of each as END; each task sums what it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for raw in column_bytes(batch, text):
                if raw:
                    found.update(raw.lower().split())
                found[END.encode()] += 1
                if len(found) > _FLUSH:
                    yield flush()
        yield flush()

    return docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Net:
    """Parameters; e: what each input adds to the gates, u: the state's part, c: classes, w: words of each class."""

    e: np.ndarray
    u: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    w: np.ndarray
    wb: np.ndarray

    NAMES = ("e", "u", "c", "cb", "w", "wb")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def like(self, flat: np.ndarray) -> Net:
        """A net of the same shapes whose parameters are views of flat."""
        parts, at = [], 0
        for k in self.NAMES:
            x = getattr(self, k)
            parts.append(flat[at : at + x.size].reshape(x.shape))
            at += x.size
        return Net(*parts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _step(net: Net, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(new state, gates z and r, candidate) of a gated recurrent unit for inputs x."""
    own = net.e.take(x, axis=0)
    zr = _sigmoid(own[:, : 2 * HIDDEN] + h @ net.u[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    g = np.tanh(own[:, 2 * HIDDEN :] + (r * h) @ net.u[:, 2 * HIDDEN :])
    return h + z * (g - h), z, r, g


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def _log_chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each row at one place."""
    with np.errstate(over="ignore"):
        total = np.exp(x) @ np.ones(x.shape[1], x.dtype)
    if not np.isfinite(total).all():
        return _log_softmax(x)[np.arange(len(x)), at]
    return x[np.arange(len(x)), at] - np.log(total)


def _by_class(cls: np.ndarray, classes: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(cls.astype(np.int16), kind="stable")  # small numbers sort by radix
    bounds = np.searchsorted(cls[order], np.arange(classes + 1))
    for k in range(classes):
        if bounds[k] < bounds[k + 1]:
            yield k, order[bounds[k] : bounds[k + 1]]


def _log_probability(net: Net, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log P of outputs y given states; outputs from the frequent words, or a class of the others."""
    frequent = len(net.w)
    cls = np.where(y < frequent * CLASS, y // CLASS, y - frequent * CLASS + frequent)
    out = _log_chosen(h @ net.c + net.cb, cls).astype(np.float64)
    for k, at in _by_class(cls, frequent):
        out[at] += _log_chosen(h[at] @ net.w[k] + net.wb[k], y[at] - k * CLASS)
    return out


def _shares(x: np.ndarray, n: np.floating) -> np.ndarray:
    """The softmax over the last axis, in place, divided by n."""
    most = x.max()
    if not most < 80:
        x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[-1], x.dtype))[..., None] * n
    return x


def _lanes(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt into lanes of about the same length, the longest first; the longest lane is the first."""
    order = np.argsort(-sizes, kind="stable").tolist()
    held = [(0, k) for k in range(min(lanes, len(order)))]
    out: list[list[int]] = [[] for _ in held]
    for i in order:
        length, k = held[0]
        out[k].append(i)
        heapq.heapreplace(held, (length + int(sizes[i]), k))
    total = [sum(int(sizes[i]) for i in own) for own in out]
    return [out[k] for k in sorted(range(len(out)), key=lambda k: -total[k])]


def _side_by_side(cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups, places): groups of TOGETHER places whose outputs are of one class, -1 where none; and each group's class."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    sizes = np.bincount(cls, minlength=classes)[:classes]
    groups = -(-sizes // TOGETHER)
    inside = order[: int(sizes.sum())]
    sorted_cls = cls[inside]
    slot = (np.cumsum(groups) - groups)[sorted_cls] * TOGETHER + np.arange(len(inside)) - (np.cumsum(sizes) - sizes)[sorted_cls]
    places = np.full(int(groups.sum()) * TOGETHER, -1, np.int64)
    places[slot] = inside
    return places.reshape(-1, TOGETHER), np.repeat(np.arange(classes), groups), groups


def _gradient(net: Net, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h0: np.ndarray, out: Net) -> np.ndarray:
    """Writes to `out` the gradient of the mean negative log-likelihood over windows x -> y (lanes by steps), by
    backpropagation through their steps; gives the states at their ends. fresh: where a text begins; y < 0 is padding."""
    rows, steps = x.shape
    x, y, going = x.T, y.T, ~fresh.T[:, :, None]  # steps by lanes
    before, after, zs, rs, gs = (np.empty((steps, rows, HIDDEN), h0.dtype) for _ in range(5))
    h = h0
    for t in range(steps):
        np.multiply(h, going[t], out=before[t])
        h, zs[t], rs[t], gs[t] = _step(net, x[t], before[t])
        after[t] = h
    after = after.reshape(-1, HIDDEN)
    target = y.ravel()
    real = np.flatnonzero(target >= 0)
    target, hs = target[real], after[real]
    frequent, n = len(net.w), np.float32(max(1, len(real)))
    at = np.arange(len(target))
    cls = np.where(target < frequent * CLASS, target // CLASS, target - frequent * CLASS + frequent)
    d = hs @ net.c
    d += net.cb
    _shares(d, n)
    d[at, cls] -= 1 / n
    out.c[:], out.cb[:] = hs.T @ d, d.sum(axis=0)
    dh_real = np.concatenate((d @ net.c.T, np.zeros((1, HIDDEN), np.float32)))
    out.w[:], out.wb[:] = 0, 0
    places, which, groups = _side_by_side(cls, frequent)
    if len(which):
        some = np.concatenate((hs, np.zeros((1, HIDDEN), np.float32)))[places]
        own = some @ net.w[which]
        own += net.wb[which][:, None]
        _shares(own, n)
        flat, kept = own.reshape(-1, CLASS), np.flatnonzero(places.ravel() >= 0)
        chosen = places.ravel()[kept]
        flat[places.ravel() < 0] = 0
        flat[kept, target[chosen] - cls[chosen] * CLASS] -= 1 / n
        present = np.flatnonzero(groups)
        begins = (np.cumsum(groups) - groups)[present]
        out.w[present] = np.add.reduceat(some.transpose(0, 2, 1) @ own, begins, axis=0)
        out.wb[present] = np.add.reduceat(own.sum(axis=1), begins, axis=0)
        dh_real[chosen] += (own @ net.w[which].transpose(0, 2, 1)).reshape(-1, HIDDEN)[kept]
    dh_all = np.zeros((rows * steps, HIDDEN), h0.dtype)
    dh_all[real] = dh_real[:-1]
    dh_all = dh_all.reshape(steps, rows, HIDDEN)
    dh = np.zeros((rows, HIDDEN), h0.dtype)
    de = np.empty((steps, rows, 3 * HIDDEN), h0.dtype)
    u_zr, u_g = net.u[:, : 2 * HIDDEN].T.copy(), net.u[:, 2 * HIDDEN :].T.copy()
    by_g, by_z, by_r = zs * (1 - gs * gs), (gs - before) * zs * (1 - zs), before * rs * (1 - rs)
    stays, resets = (1 - zs) * going, rs * going
    for t in range(steps - 1, -1, -1):
        dh += dh_all[t]
        dzr, dg = de[t, :, : 2 * HIDDEN], de[t, :, 2 * HIDDEN :]
        np.multiply(dh, by_g[t], out=dg)
        np.multiply(dh, by_z[t], out=dzr[:, :HIDDEN])
        back = dg @ u_g
        np.multiply(back, by_r[t], out=dzr[:, HIDDEN:])
        dh = dh * stays[t] + back * resets[t] + (dzr @ u_zr) * going[t]
    flat = de.reshape(-1, 3 * HIDDEN)
    out.u[:, : 2 * HIDDEN] = before.reshape(-1, HIDDEN).T @ flat[:, : 2 * HIDDEN]
    out.u[:, 2 * HIDDEN :] = (rs * before).reshape(-1, HIDDEN).T @ flat[:, 2 * HIDDEN :]
    inputs = x.ravel().astype(np.min_scalar_type(len(net.e)))  # narrow numbers are sorted by their digits
    order = np.argsort(inputs, kind="stable")
    inputs = inputs[order]
    begins = np.flatnonzero(np.concatenate(([True], inputs[1:] != inputs[:-1])))
    out.e[:] = 0
    out.e[inputs[begins]] = np.add.reduceat(flat[order], begins, axis=0)
    return h


def _trained(net: Net, texts: list[np.ndarray], end: int, rate: float) -> np.ndarray:
    """Parameters after Adam over all windows of the texts (outputs, each ending with `end`), from first to last."""
    theta = net.flat().astype(np.float32)
    own, grad = net.like(theta), np.zeros_like(theta)
    out, m, v, move = net.like(grad), np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(theta)
    sizes = np.array([len(t) for t in texts])
    side = min(TRAIN_LANES, max(16, int(sizes.sum()) // (50 * SPAN)))
    lanes = [np.concatenate([texts[i] for i in lane]).astype(np.int64) for lane in _lanes(sizes, side)]
    h, k = np.zeros((len(lanes), HIDDEN), np.float32), 0
    for t in range(0, len(lanes[0]), SPAN):
        live = sum(len(lane) > t for lane in lanes)
        y = np.full((live, SPAN + 1), -1, np.int64)
        for j in range(live):
            part = lanes[j][max(0, t - 1) : t + SPAN]
            y[j, int(t == 0) : int(t == 0) + len(part)] = part
        if t == 0:
            y[:, 0] = end
        h = _gradient(own, np.maximum(y[:, :-1], 0), y[:, 1:], y[:, :-1] == end, h[:live], out)
        k += 1
        m += np.float32(0.1) * (grad - m)
        np.multiply(grad, grad, out=move)
        v += np.float32(0.01) * (move - v)
        np.sqrt(v, out=move)
        move *= np.float32(1 / np.sqrt(1 - 0.99**k))
        move += np.float32(1e-6)
        np.divide(m, move, out=move)
        filled = min(1.0, float((y[:, 1:] >= 0).sum()) / FULL)  # where few lanes are left a step is shorter
        theta -= np.float32(filled * rate / (1 - 0.9**k)) * move
    return theta


class _Head(dict):
    """Numbers of words; -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Model:
    total: int  # training tokens
    types: int
    head: dict[bytes, int]  # words with a count of `least` or more: their numbers
    least: int
    counts: np.ndarray  # of the head words
    output: np.ndarray  # of the head words: a frequent word, or a class of the others
    rest_total: np.ndarray  # tokens and types of each class of other words
    rest_types: np.ndarray
    net: Net | None = None

    @property
    def frequent(self) -> int:
        return len(self.net.w) * CLASS

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.head.__getitem__, words), np.int64, len(words))

    def outputs(self, words: list[bytes], numbers: np.ndarray) -> np.ndarray:
        """For each word and the end: the frequent word it is, or the class of other words."""
        out = np.empty(len(words) + 1, np.int64)
        out[:-1] = self.output[numbers]
        first = self.frequent
        for k in np.flatnonzero(numbers < 0).tolist():
            out[k] = first + _rest(words[k])
        out[-1] = self.output[self.head[END.encode()]]
        return out


def _start(m: Model) -> Net:
    """A net that gives each word its share of the counts, whatever came before."""
    classes = min(CLASSES, -(-len(m.output) // CLASS))
    rng = np.random.default_rng(7)
    count = np.full(classes * CLASS, 1e-9)
    inside = m.output < classes * CLASS
    count[m.output[inside]] = np.maximum(m.counts[inside], 1e-9)
    per = count.reshape(classes, CLASS)
    wb = np.log(per / per.sum(axis=1, keepdims=True))
    mass = np.concatenate((per.sum(axis=1), m.rest_total + m.rest_types + 1.0))
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Net(small(classes * CLASS + REST, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), small(HIDDEN, classes + REST), np.log(mass / mass.sum()).astype(np.float32), small(classes, HIDDEN, CLASS) * 0.1, np.maximum(wb, -30).astype(np.float32))


def _statistics(counts: DataFrame) -> Model:
    """Totals and the head words; only HEAD words at most come to the driver."""
    n_all, types = counts.agg(F.sum("n"), F.count("*")).first()
    if not types:
        return Model(0, 0, _Head({END.encode(): 0}), 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(REST), np.zeros(REST))
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r.s)
    held, least = 0, (steps[0].n if steps else 1)
    for r in steps:
        held += r.k
        if held > HEAD:
            break
        least = r.n
    rows = sorted(((-r.n, r.word.encode()) for r in counts.where(F.col("n") >= least).collect()))
    end = END.encode()
    if not any(w == end for _, w in rows):
        rows.append((-counts.where(F.col("word") == END).first().n, end))
    rows.sort(key=lambda x: (x[1] != end, x))  # the end is always among the frequent words
    first = CLASSES * CLASS if len(rows) > CLASSES * CLASS else -(-len(rows) // CLASS) * CLASS
    output = np.array([k if k < first else first + _rest(w) for k, (_, w) in enumerate(rows)], np.int64)
    frequent = [w.decode() for _, w in rows[:first]]
    n_rest, t_rest = np.zeros(REST), np.zeros(REST)
    key = (F.crc32(F.substring(F.col("word").cast("binary"), 1, 3)) % REST).cast("int")
    for k, n, t in counts.groupBy(key.alias("k")).agg(F.sum("n"), F.count("*")).collect():
        n_rest[k], t_rest[k] = n, t
    for (n, w), _ in zip(rows, frequent):
        n_rest[_rest(w)] += n
        t_rest[_rest(w)] -= 1
    return Model(n_all, types, _Head((w, k) for k, (_, w) in enumerate(rows)), least, np.array([-n for n, _ in rows], np.int64), output, n_rest, t_rest)


def _outputs(docs: DataFrame, model, text: str) -> DataFrame:
    """round and ids (outputs to its end) of every whole text; a hash of the text gives its round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for texts in blocks(column_bytes(batch, text), len(batch), BLOCK_CHARS):
                rounds = [zlib.crc32(t or b"") % ROUNDS for t in texts]
                rows = []
                for t in texts:
                    words = (t or b"").lower().split()
                    rows.append(m.outputs(words, m.numbers(words)).astype(np.int32))
                offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(rounds, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))], names=["round", "ids"])

    return docs.select(text).mapInArrow(run, "round int, ids array<int>")


def _average(texts: DataFrame, net: Net, end: int, rate: float) -> Net:
    """Each task trains its own copy of the net on its texts (ids); the mean of the copies, by their tokens."""
    held = texts.sparkSession.sparkContext.broadcast(net)  # about a MB whatever the input
    width = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.asarray(x.values).astype(np.int16) for b in batches for x in b.column(0)]
        if not rows:
            return
        n = sum(map(len, rows))
        theta = _trained(held.value, rows, end, rate) * np.float32(n)
        parts = [theta[k : k + width] for k in range(0, len(theta), width)]
        salt = TaskContext.get().partitionId() % 32
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["part", "salt", "n", "sum"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("sum")[0].as_py()) // 4)
        for x in table.column("sum"):
            total += np.frombuffer(x.as_py(), np.float32)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "sum": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "part int, salt int, n bigint, sum binary"
    some = texts.select("ids").mapInArrow(run, schema).groupBy("part", "salt").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    got = sorted(some.collect(), key=lambda r: r.part)
    return net.like(np.concatenate([np.frombuffer(bytes(r["sum"]), np.float32) / r.n for r in got])) if got else net


def train(docs: DataFrame, text: str = "text", tokens_a_task: int = 2_000_000) -> tuple[Model, DataFrame]:
    """(model, counts of all words) from all texts of docs; null texts count as empty ones, whose only token is the end.

    The network learns from every token of every text. A task trains on about tokens_a_task of them, and the mean over
    tasks goes on to the next round. Without any text nothing is counted and the net stays as it begins.
    """
    counts = written(word_counts(docs, text), "counts")
    model = _statistics(counts)
    model.net = _start(model)
    held = docs.sparkSession.sparkContext.broadcast(model)  # HEAD words with their counts at most
    end = int(model.output[model.head[END.encode()]])
    texts = written(_outputs(docs, held, text), "outputs")
    tasks = max(1, -(-model.total // (ROUNDS * tokens_a_task)))
    for k in range(ROUNDS):
        own = texts.where(F.col("round") == k).repartition(tasks, F.xxhash64("ids", F.rand(k)))
        model.net = _average(own, model.net, end, 0.02 / (1 + k))
    dropped(texts)
    return model, counts


def _looked_up(m: Model, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[Counter[bytes]]]:
    """(known head words, base sum, sum of the words' shares of their classes, outputs, tail words) of each text.

    The sums lack log10(c + 1) of the tail words.
    """
    base_down = np.log10(m.total + m.types + 1)
    head_log = np.log10(m.counts + 1.0)
    rest_down = np.log10(m.rest_total + m.rest_types + 1.0)
    end_number = m.head[END.encode()]
    known, base, score, outs, tails = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts)), [], []
    for k, words in enumerate(texts):
        numbers = m.numbers(words)
        inside = numbers[numbers >= 0]
        tails.append(Counter(map(words.__getitem__, np.flatnonzero(numbers < 0).tolist())))
        known[k] = len(inside) + (m.total > 0)
        base[k] = head_log[inside].sum() + head_log[end_number] - base_down * (len(words) + 1)
        out = m.outputs(words, numbers)
        other = out >= m.frequent
        if other.any():
            score[k] = -rest_down[out[other] - m.frequent].sum() + head_log[inside[m.output[inside] >= m.frequent]].sum()
        outs.append(out.astype(np.int32))
    return known, base, score, outs, tails


def _net_scores(m: Model, outs: list[np.ndarray]) -> np.ndarray:
    """log10 of the net's probability of each text's outputs, the texts in lanes side by side."""
    score, end = np.zeros(len(outs)), m.output[m.head[END.encode()]]
    log_10 = np.log(10)
    lanes = _lanes(np.array([len(o) for o in outs]), LANES)
    order = [i for lane in lanes for i in lane]
    y, whose = np.concatenate([outs[i] for i in order]), np.repeat(order, [len(outs[i]) for i in order])
    length = np.array([sum(len(outs[i]) for i in lane) for lane in lanes])
    start = np.cumsum(length) - length
    h, x = np.zeros((len(lanes), HIDDEN), np.float32), np.full(len(lanes), end)
    for t0 in range(0, int(length[0]), STEPS):
        states, places = [], []
        for t in range(t0, min(t0 + STEPS, int(length[0]))):
            live = int(np.searchsorted(-length, -t, side="left"))  # lanes with more than t outputs
            x = x[:live]
            h, *_ = _step(m.net, x, h[:live] * (x != end)[:, None])  # a text begins with the zero state
            states.append(h)
            places.append(start[:live] + t)
            x = y[places[-1]]
        at = np.concatenate(places)
        score += np.bincount(whose[at], _log_probability(m.net, np.concatenate(states), y[at].astype(np.int64)) / log_10, minlength=len(outs))
    return score


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10), over whole texts.

    Null and empty texts consist of their end. Rows, repeated ones too, and other columns stay as they are, those
    called like a result are replaced. Words that the tasks do not hold get their counts by a join, summed for a text
    and word before anything moves.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # HEAD words and the net
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    source = docs.drop("train_tokens", *(f.name for f in added))
    row, tail, log, extra = free_names(source, "row", "tail", "log", "known")
    kind = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("times", T.IntegerType())]))
    keep = [c for c in source.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, number = held.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            found, done = [], 0

            def scored() -> pa.RecordBatch:
                known, base, own, outs, tails = (list(chain.from_iterable(x)) for x in zip(*found))
                own = np.array(own) + _net_scores(m, outs)
                words = pa.array(list(chain.from_iterable(tails)), pa.binary()).cast(pa.string())
                times = pa.array(list(chain.from_iterable(t.values() for t in tails)), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tails)]), pa.int32()), pa.StructArray.from_arrays([words, times], names=["word", "times"]))
                new = [pa.array([len(o) for o in outs], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own), pa.array(range(number, number + len(outs)), pa.int64()), lists]
                part = batch.slice(done, len(outs))
                return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *new], names=[*keep, *(f.name for f in added), row, tail])

            for some in blocks(column_bytes(batch, text), len(batch), BLOCK_CHARS):
                found.append(_looked_up(m, [(x or b"").lower().split() for x in some]))
                if sum(len(o) for x in found for o in x[3]) > WAITING:
                    out = scored()
                    number, done, found = number + len(out), done + len(out), []
                    yield out
            if found:
                out = scored()
                number += len(out)
                yield out

    schema = T.StructType([*(source.schema[c] for c in keep), *added, T.StructField(row, T.LongType()), T.StructField(tail, kind)])
    part = written(source.mapInArrow(run, schema), "scores")
    words = part.select(F.col(row), F.inline(tail))
    rare = counts.where(F.col("n") < model.least)
    found = words.join(rare, "word", "left").groupBy(row).agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias(log), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias(extra))
    joined = part.drop(tail).join(found, row, "left")
    more = F.coalesce(F.col(log), F.lit(0.0))
    return joined.select(*(F.col(f"`{c}`") for c in keep), "n_tokens", (F.col("n_known") + F.coalesce(F.col(extra), F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
