"""Byte-level BPE encoding by a pair occurrence index, and decoding."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How the vocabulary's byte-level pre-tokenizer splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts whose characters are all below U+0100, with its classes spelled out for the faster `re`.
_S, _L, _N = r"\t-\r\x20\x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
LATIN_SPLIT = f" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Letters and numbers of Unicode 17, which `regex` knows and the vocabulary's library takes for symbols.
NEWER = (
    "558, 58B-58C, 88F, C5C, CDC, 208F, 209D-209F, A7CE-A7CF, A7D2, A7D4, A7DD, A7E2, A7F1, AB6C-AB6D, 107BB-107BF, "
    "10940-10959, 10EC5-10EC7, 10ED9-10EEE, 11B0A, 11DB0-11DDB, 11DE0-11DE9, 11DF1, 1246F, 12475-1247F, 12550-12686, "
    "16EA0-16EB8, 16EBB-16ED3, 16FF2-16FF6, 187F8-187FF, 18CD6-18CDA, 18D09-18D20, 18D80-18DF2, 18E00-19191, 191A0-191D2, "
    "1B123-1B128, 1B168, 1D6A6, 1DF1F-1DF24, 1DF2B-1DF81, 1DF90-1DF96, 1DFCD-1DFFF, 1E6C0-1E6DE, 1E6E0-1E6E2, 1E6E4-1E6E5, "
    "1E6E7-1E6ED, 1E6F0-1E6F4, 1E6FE-1E6FF, 2B73A-2B73F, 2B81E, 2CEA2-2CEAD, 323B0-33479, 3D000-3FC3F"
)
#: Characters worked on at once, and words that a task remembers before it starts anew.
BLOCK_CHARS, REMEMBERED = 1_000_000, 200_000


def byte_letters() -> list[str]:
    """The printable letter of each byte in the vocabulary file: itself if printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need of a tokenizers JSON file (byte-level BPE without normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is supported")
        for name in ("ignore_merges", "byte_fallback", "dropout", "continuing_subword_prefix", "end_of_word_suffix"):
            if model.get(name):
                raise ValueError(f"{path}: {name} is not supported")
        for x in spec["added_tokens"]:
            if any(x.get(flag) for flag in ("single_word", "lstrip", "rstrip")):
                raise ValueError(f"{path}: added tokens that match with their surroundings are not supported")
        ids, letters = model["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.pieces = [b""] * self.size
        for token, i in ids.items():
            self.pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.left, self.right, self.made = left, right, np.array([ids[a + b] for a, b in merges], np.int64)
        codes = left * self.size + right
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs; -1 where there is none."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.codes[at] == code), self.order[at], -1)


def _by_rank(ranks: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    known = ranks >= 0
    ranks, at = ranks[known], at[known]
    if len(ranks):
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        yield from zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts))


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each word).

    `where` maps the rank of each pair that can merge to all its positions. Active ranks are taken in ascending order;
    merging one visits its positions only, and adds the positions of the pairs that arise to their lists. A position
    whose pair has gone meanwhile is passed over when its turn comes.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    sym = np.concatenate((v.byte_ids[raw], [-1]))  # the last place stands for the end of a word
    nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.cumsum(sizes)[sizes > 0]
    nxt[ends - 1] = n
    prv[(ends - sizes[sizes > 0])] = n
    where: dict[int, list[np.ndarray]] = {}
    places = np.arange(n)
    active = []
    for rank, at in _by_rank(v.ranks(sym[places], sym[nxt[places]]), places):
        where[rank] = [at]
        active.append(rank)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        a, b, new = int(v.left[rank]), int(v.right[rank]), int(v.made[rank])
        lists = where.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
        if a == b and len(at) > 1:  # in a run of equal symbols every second pair overlaps the one before
            at = np.unique(at)
            begins = np.concatenate(([True], nxt[at[:-1]] != at[1:]))
            first = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        sym[at], sym[gone] = new, -2
        nxt[at] = after
        prv[after] = at
        prv[n] = n
        before = prv[at]
        before = before[before < n]
        changed = np.concatenate((before, at))
        for r, more in _by_rank(v.ranks(sym[changed], sym[nxt[changed]]), changed):
            if r in where:
                where[r].append(more)
            else:
                where[r] = [more]
                heapq.heappush(active, r)
    kept = sym[:n] >= 0
    word = np.repeat(np.arange(len(words)), sizes)
    return sym[:n][kept].astype(np.int32), np.bincount(word[kept], minlength=len(words))


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] for all i, one after the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else starts, sizes)
    return flat[shift + np.arange(total)]


class _Seen(dict):
    """Numbers of words in order of first sight; new ones are listed in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.split = regex.compile(SPLIT).findall
        self.latin_split = re.compile(LATIN_SPLIT).findall
        newer = "".join("-".join(f"\\U{int(c, 16):08x}" for c in run.split("-")) for run in NEWER.split(", "))
        self.newer = re.compile(f"[{newer}]").search
        inner = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])").replace(r"\p{L}+|", rf"(?:(?![{newer}])\p{{L}})+|").replace(r"\p{N}+|", rf"(?:(?![{newer}])\p{{N}})+|")
        self.older_split = regex.compile(inner).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")").split if v.special else None
        self._forget()

    def _forget(self) -> None:
        self.seen = _Seen()
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            split = self.latin_split
        except UnicodeEncodeError:
            split = self.older_split if self.newer(text) else self.split
        if not self.cut or not any(s in text for s in self.v.special):
            return split(text)
        words: list[str] = []
        for k, part in enumerate(self.cut(text)):
            words += [f"\0{part}"] if k % 2 else split(part)  # no word of the pattern mixes NUL with a special token
        return words

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null texts have none."""
        if len(self.seen) > REMEMBERED:
            self._forget()
        number = self.seen.__getitem__
        words, before = [], None
        for t in texts:
            if not words or t != before:  # repeated rows come one after the other
                found = self._words(t) if t else []
                own = np.fromiter(map(number, found), np.int64, len(found))
            words.append(own)
            before = t
        if fresh := self.seen.fresh:
            special = {k: self.v.special[w[1:]] for k, w in enumerate(fresh) if w[0] == "\0" and w[1:] in self.v.special}
            ids, sizes = encode_words([b"" if k in special else w.encode() for k, w in enumerate(fresh)], self.v)
            for k, i in sorted(special.items(), reverse=True):
                ids, sizes[k] = np.insert(ids, int(sizes[:k].sum()), i), 1
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, ids))
            fresh.clear()
        every = np.concatenate(words) if words else np.empty(0, np.int64)
        sizes = self.sizes[every]
        total = np.concatenate(([0], np.cumsum(sizes)))
        cuts = np.cumsum([0, *map(len, words)])
        return gather(self.flat, self.starts[every], sizes), np.diff(total[cuts])


def _blocks(batches: Iterable[pa.RecordBatch], column: str, length) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches that hold about BLOCK_CHARS (or one longer row), with the values of `column`."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        begin, held, values = 0, 0, []
        for k, x in enumerate(batch.column(at)):
            x = x.as_py() if length is len else x.values
            values.append(x)
            held += length(x) if x is not None else 0
            if held >= BLOCK_CHARS:
                yield batch.slice(begin, k + 1 - begin), values
                begin, held, values = k + 1, 0, []
        if values:
            yield batch.slice(begin), values


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


class Decoder:
    def __init__(self, v: Vocabulary):
        self.flat = np.frombuffer(b"".join(v.pieces), np.uint8)
        self.sizes = np.fromiter(map(len, v.pieces), np.int64, len(v.pieces))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts of ids one after the other, `sizes` of them each."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.sizes):
            raise ValueError("a token id is outside the vocabulary")
        raw = gather(self.flat, self.starts[ids], self.sizes[ids]).tobytes()
        ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))[np.cumsum([0, *sizes])].tolist()
        return pa.array((raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])), pa.string())


def _id_lists(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with `out`, the token ids (array of int) of the whole text, as the vocabulary's own library encodes it.

    A null or empty text has no ids. The strings of special tokens count as those tokens. Rows and other columns stay
    as they are, repeated rows too; a column that is already called `out` is replaced. With `decoded` that column has
    the text decoded from the ids again, in the same pass.
    """
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))  # one vocabulary file: some MB whatever the input
    kept = docs.drop(out, *([decoded] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(v.value), Decoder(v.value)
        for batch, texts in _blocks(batches, text, len):
            ids, sizes = encoder.encode(texts)
            done = _with(batch, out, _id_lists(ids, sizes))
            yield _with(done, decoded, decoder.decode(ids, sizes)) if decoded else done

    added = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with `out`, the text of the token ids, special tokens included; bytes that are not UTF-8 become U+FFFD.

    A null or empty array gives the empty text; a null among the ids is passed over; an id that the vocabulary lacks
    is an error. Rows and other columns stay as they are; a column that is already called `out` is replaced.
    """
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    kept = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(v.value)
        for batch, rows in _blocks(batches, ids, lambda x: 3 * len(x)):
            arrays = [np.asarray(x.drop_null(), np.int64) if x is not None else np.empty(0, np.int64) for x in rows]
            every = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
            yield _with(batch, out, decoder.decode(every, np.array([len(a) for a in arrays], np.int64)))

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def digests(docs: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""
    return docs.withColumns(
        {
            "n_tokens": F.size(ids).cast("bigint"),
            "ids_sha256": F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256),
            "decoded_sha256": F.sha2(F.col(decoded), 256),
        }
    )
