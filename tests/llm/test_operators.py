"""Each operator against a plain version on small tables, with the odd rows that its docstring names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from pagesim.llm import bpe, langid, linedup, lm, media, mixing, quality, queries, simhash, substring, toxicity
from pagesim.llm.common import components, written
from pagesim.llm.features import calibrated

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string"
SF = "/root/testdata/sf0.001"


def prose(rng, n, words="alpha beta gamma delta omega the of and to in river stone cloud field night light".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", str(rng.randrange(300))]) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0] + " tail"), (22, ""), (23, None), (24, " \t\n "), (25, "one"), (25, "one"), (None, "lost words here"), (26, "ÄÖ 漢字 \U0001f600 x\x00y"), (27, prose(rng, 6000))]
    rows += [(30, "a line of some words here\nanother line of words there\n" + base[1]), (31, "another line of words there\nfresh line\n\n" + base[1].replace("alpha", "ALPHA", 1))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# SimHash
def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, docs):
    rows = odd_rows()
    marks = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    want = sorted((str(i), f"{marks[k]:016x}", str(min((x for x in least[find(k)] if x is not None), default=None))) for k, (i, _) in enumerate(rows))
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash")))
    assert sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", str(r.component_id)) for r in got.collect()) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_close_pairs_find_every_pair(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    marks = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            marks.add(b ^ sum(1 << k for k in rng.sample(range(64), n)))
    signed = sorted(m - (1 << 64) if m >> 63 else m for m in marks)
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    got = simhash.close_pairs(spark.createDataFrame([(m,) for m in signed], "fp bigint")).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        simhash.close_pairs(spark.createDataFrame([(1,)], "fp bigint"), 4)


def test_keep_first_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(3, "x y z w"), (1, "x y z w"), (1, "x y z w"), (5, prose(random.Random(1), 40)), (None, "x y z w")], SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [1, 5]


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# BPE
def test_bpe_equals_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    t = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    letters = [*" \t\n\r\x1c\x85\xa0 　aabbAé漢'sdt123!?²½\0", "<|endoftext|>", "'ll", " 'Re", "\U0001f600", "́", "aaaaaaaa", "Ᲊ", "Ɤ"]
    fuzz = [(100 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for k in range(400)] + [(900, "ab" * 4000), (901, "\0<|endoftext|>")]
    rows = odd_rows() + fuzz
    table = spark.createDataFrame([(i, x, 7) for i, x in rows], SCHEMA + ", ids int")
    both = bpe.encode(table, path, decoded="again")
    out = bpe.digests(bpe.decode(both, path)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.again == r.decoded
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(empty(spark), path).count() == 0


def test_bpe_splits_every_character_as_the_library_does():
    tokenizers = pytest.importorskip("tokenizers")
    pre = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    own = bpe.Encoder(bpe.Vocabulary(queries.vocabulary_path()))
    for c in [*range(0x3000), *range(0x3000, 0x110000, 61)]:
        if not 0xD800 <= c < 0xE000:
            s = f"a{chr(c)}1{chr(c)}! {chr(c)}b"
            assert [len(w) for w in own._words(s)] == [b - a for _, (a, b) in pre.pre_tokenize_str(s)], hex(c)


def test_bpe_decode_refuses_unknown_ids(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>"), queries.vocabulary_path()).collect()


# Line dedup
def plain_lines(rows, threshold=0.8):
    place = sorted({(i is not None, i or 0, t) for i, t in rows if t})
    first, sets = {}, {}
    for key in place:
        for k, line in enumerate(key[2].split("\n")):
            words = frozenset(WORD.findall(line))
            if words and line not in first:
                first[line], sets[line] = (*key[:2], k), words
    links = {a: [b for b in first if a != b and len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 10 * threshold - 1e-9] for a in first}
    out = {}
    for i, t in rows:
        kept, n = [], 0
        for k, line in enumerate(t.split("\n")) if t is not None else ():
            if line in first:
                repeats, similar = (i is not None, i or 0, k) > first[line], any(first[x] < first[line] for x in links[line])
                n += similar and not repeats
                if repeats or similar:
                    continue
            kept.append(line)
        out[i, t] = (None if t is None else "\n".join(kept), n)
    return out


@pytest.mark.parametrize("heavy, leaders", [(64, 3), (2, 1)])
def test_linedup_matches_brute_force(spark, monkeypatch, heavy, leaders):
    monkeypatch.setattr(linedup, "HEAVY", heavy)
    monkeypatch.setattr(linedup, "LEADERS", leaders)
    rng = random.Random(9)
    lines = [prose(rng, rng.randrange(1, 30)) for _ in range(60)]
    rows = [(k, "\n".join((w := rng.choice(lines).split(" "), w.__setitem__(rng.randrange(len(w)), f"n{rng.randrange(9)}") if rng.random() < 0.5 else None)[0] and " ".join(w) for _ in range(rng.randrange(1, 9)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "\n \n"), (203, rows[0][1]), (204, "tab\tsplit words here\r"), (205, "words here split tab")]
    near = [f"w{k}" for k in range(70)]
    rows += [(300 + k, " ".join([*near[: k % 7 * 2], f"x{k}", *near[k % 7 * 2 + 2 :]])) for k in range(40)]  # a group of near copies
    want = plain_lines(rows)
    table = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA + ", n_similar string, gone string, id string")
    got = linedup.dedupe_lines(table.withColumn("original", F.col("text"))).collect()
    assert {(r.doc_id, r.original): (r.text, r.n_similar) for r in got} == want
    assert sum(r.n_similar for r in got) > 50 and {(r.gone, r.id) for r in got} == {("y", "z")}
    assert linedup.dedupe_lines(empty(spark)).count() == 0


def test_linedup_tells_words_of_one_short_hash_apart(spark):
    seen, pairs = {}, []
    for k in range(300_000):
        h = xxhash.xxh64_intdigest(f"w{k}".encode(), seed=42) & 0xFFFFFFFF  # Spark's seed
        if h in seen:
            pairs.append((f"w{seen[h]}", f"w{k}"))
        seen[h] = k
    assert pairs
    rows = [(2 * i + j, w) for i, pair in enumerate(pairs) for j, w in enumerate(pair)]
    got = linedup.dedupe_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text, r.n_removed, r.n_similar) for r in got) == [(k, w, 0, 0) for k, w in rows]


@pytest.mark.parametrize("rarity_part, list_part", [(1, 1), (1000, 1000)])
def test_linedup_estimates_change_no_result(spark, monkeypatch, rarity_part, list_part):
    rng = random.Random(10)
    near = [f"w{k}" for k in range(20)]
    rows = [(k, "\n".join([" ".join([*near[: k % 19], f"x{k}", *near[k % 19 + 1 :]]), prose(rng, 12)])) for k in range(60)]
    monkeypatch.setattr(linedup, "HEAVY", 8)
    monkeypatch.setattr(linedup, "RARITY_PART", rarity_part)
    monkeypatch.setattr(linedup, "LIST_PART", list_part)
    got = linedup.dedupe_lines(spark.createDataFrame(rows, SCHEMA).withColumn("original", F.col("text"))).collect()
    assert {(r.doc_id, r.original): (r.text, r.n_similar) for r in got} == plain_lines(rows)
    assert sum(r.n_similar for r in got) > 50


def test_linedup_counts_rarity_over_a_part_of_each_text(spark):
    texts = [(k, "w " * 8000 + f"x{k}") for k in range(8)]
    table = linedup.rarity(spark.createDataFrame(texts, SCHEMA)).first()["table"]
    words = 2 ** ((max(table) >> 56) / 4)
    assert len(table) == 1 << linedup.BUCKET_BITS and 6000 < words < 11000  # an eighth of 64,000


def test_linedup_takes_odd_rows(spark, docs):
    got = linedup.dedupe_lines(docs).collect()
    assert len(got) == len(odd_rows())
    assert [r.text for r in got if r.doc_id == 25] == ["one", "one"]


# Columns of the caller
CLASHING = ["id", "hash", "gone", "n", "lines", "rest", "salt", "shared", "later", "row", "tail", "log", "known", "b", "t", "s0", "fp", "p_zip", "_rank", "_hash", "_id", "_n", "_row", "_t", "_d", "digest", "line", "bits", "part", "y", "h", "bucket"]
OPERATORS = {
    "op1": lambda d, l: toxicity.score(d, toxicity.train(d, l)),
    "op2": lambda d, l: mixing.fit_rates(mixing.posteriors(d, mixing.train(d, l)), {"a": 1, "b": 1}, most_gap=None),
    "op3": lambda d, l: lm.score(d.withColumn("text_", F.col("text")), *lm.train(d)).withColumnRenamed("text_", "text"),
    "op4": lambda d, l: linedup.dedupe_lines(d, out="deduped"),
    "op5": lambda d, l: bpe.encode(d, queries.vocabulary_path(), out="codes", decoded="back"),
    "op6": lambda d, l: substring.dedupe(d),
    "op7": lambda d, l: simhash.keep_first(d),
    "op8": lambda d, l: langid.predict(d, langid.train(d)),
    "op10": lambda d, l: quality.judge(d, quality.train(d, l)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_the_caller_stay(spark, name):
    rng = random.Random(31)
    long = " ".join(f"w{k % 5000}" for k in range(120_000))
    texts = [prose(rng, 50) for _ in range(20)] + [long, None, "", "one"]
    rows = [(k, t, "en", *(f"{c}{k}" for c in CLASHING)) for k, t in enumerate(texts)] + [(3, texts[3], "en", *(f"{c}3" for c in CLASHING))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    labels = spark.createDataFrame([(k, k % 2, k % 2, "ab"[k % 2]) for k in range(20)], "doc_id bigint, toxic int, quality int, domain string")
    got = OPERATORS[name](docs, labels).collect()
    want = Counter((i, t, *rest) for i, t, _, *rest in rows)
    own = Counter((r.doc_id, r.text, *(r[c] for c in CLASHING)) for r in got)
    assert own == want if name != "op7" else set(own) <= set(want) and set(own.values()) == {1}
    assert OPERATORS[name](docs.limit(0), labels).count() == 0


# Rows that share an id
def test_texts_that_share_an_id_keep_their_own(spark):
    rng = random.Random(17)
    a, b, c = (prose(rng, 150) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (None, c), (None, b + " " + a), (7, None), (7, None)]
    got = {(r.doc_id, r.text): r for r in substring.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5, b].removed_spans and got[5, b].deduped != b  # the row without an id comes first and has it
    assert got[None, c].deduped == c and not got[None, c].shared_spans and got[7, None].deduped is None
    assert len(got[1, a].deduped) < 40 and len(got[5, a].deduped) < 40 and got[None, b + " " + a].deduped == b + " " + a
    kept = simhash.keep_first(spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (None, a), (None, c)], SCHEMA)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, a), (5, b), (None, c)])


# Substring dedup
def test_cuts_come_back_after_an_insertion():
    rng = random.Random(4)
    raw = prose(rng, 400).encode()
    moved = b"something new " + raw

    def chunks(x):
        ends = [0, *substring.cuts(x)]
        assert ends[-1] == len(x) and all(b > a for a, b in zip(ends, ends[1:]))
        return {x[a:b] for a, b in zip(ends, ends[1:])}

    own = chunks(raw)
    assert len(own & chunks(moved)) >= len(own) - 6
    assert substring.cuts(b"") == [] and substring.cuts(b"x") == [1]
    h = 0
    for b in raw[100:132]:
        h = (h << 1) + int(substring.GEAR[b]) & 0xFFFFFFFF
    full = substring.GEAR[np.frombuffer(raw, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        full[step:] += full[:-step].copy() << np.uint32(step)
    assert int(full[131]) == h


def test_passages_of_51_words_share_runs():
    """Passages between different texts, of ordinary words or of few distinct ones: nearly all give a run."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    for distinct, least_recall in ((3000, 0.99), (4, 0.98), (2, 0.98)):
        found = 0
        for _ in range(300):
            own = rng.sample(vocabulary, distinct)
            passage = " ".join(rng.choice(own) for _ in range(51))
            texts = [" ".join((*rng.choices(vocabulary, k=rng.randrange(20, 60)), passage, *rng.choices(vocabulary, k=40))).encode() for _ in range(2)]
            (ends, one), (_, other) = ((substring.cuts(t), substring._digests(t)) for t in texts)
            found += bool(substring._runs([k for k, d in enumerate(one) if d in set(other)], ends, 80))
        assert found >= least_recall * 300


def test_substring_finds_planted_passages(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    passage = prose(rng, 55, vocabulary)
    rows = [(k, prose(rng, 200, vocabulary)) for k in range(30)]
    for k in (3, 9, 17):
        rows[k] = (k, prose(rng, 50, vocabulary) + " é " + passage + " " + prose(rng, 50, vocabulary))
    rows += [(40, None), (41, ""), (42, rows[5][1]), (None, rows[6][1])]
    got = {r.doc_id: r for r in substring.dedupe(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    shared = {k for k, r in got.items() if r.shared_spans}
    assert shared == {3, 9, 17, 5, 42, 6, None}
    assert not got[3].removed_spans and got[3].deduped == rows[3][1]
    middle = " ".join(passage.split(" ")[15:40])
    assert middle not in got[9].deduped and middle not in got[17].deduped
    assert got[42].deduped == "" and got[40].deduped is None and got[6].deduped == ""
    assert substring.dedupe(empty(spark)).count() == 0


# Language ID
def test_langid_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    model = langid.train(docs.where("not held"))
    got = langid.predict(docs, model).where("held").select("lang", "lang_pred", "score", "rejected").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all() and got.rejected.mean() < 0.02
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "漢字漢字"), (5, "the of and")], SCHEMA + "")
    rows = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(rows[k].rejected for k in (1, 2, 3, 4)) and rows[5].lang_pred == "en"


def test_langid_without_labels(spark, docs):
    model = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


# Quality
def plain_counts(t):
    words = WORD.findall(t or "")
    seen, dup, at, cover = set(), 0, defaultdict(list), set()
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    for places in at.values():
        if len(places) > 1:
            cover.update(x for k in places for x in range(k, k + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality_counts_and_verdicts(spark, docs):
    rows = odd_rows() + [(50, "a b c d e f g h " * 9), (51, "x\nx\n\n \n x\n#$|<>"), (52, "é 漢 y\x1cz")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    table = spark.createDataFrame(rows, SCHEMA)
    got = quality.judge(table, quality.train(table, labels)).collect()
    assert Counter((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((str(i), *plain_counts(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.judge(empty(spark), quality.train(table, labels.limit(0))).count() == 0


def test_quality_on_labelled_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.judge(docs, quality.train(docs, labels)).join(labels.withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").select("label", "kept").toPandas()
    assert (got.kept == (got.label == 1)).mean() > 0.95


# Toxicity
def plain_terms(text):
    found = Counter()
    for w in re.findall(rb"[^ \t-\r" + re.escape(toxicity._MARKS).encode() + rb"]+", (text or "").lower().encode()):
        for k in (0, *(k for k in toxicity.STEMS if len(w) > k)):
            h = sum(b * pow(toxicity.PRIME, i, 1 << 64) for i, b in enumerate(w[: k or len(w)])) + k * toxicity.SALT
            h %= 1 << 64
            found[((h ^ h >> 29) * toxicity.MIX % (1 << 64)) >> (64 - toxicity.BITS)] += 1
    for b, n in list(found.items()):
        for k, least in enumerate(toxicity.LEVELS, 1):
            if n >= least:
                found[b + (k << toxicity.BITS)] = n
    return found


def test_toxicity_scores_are_those_of_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.choice([0, 1, 5, 60])) + (" idiot clown idiots" * rng.randrange(1, 3) if k % 6 == 0 else "")) for k in range(400)] + [(500, None), (501, "zzz")]
    labels = {k: int(k % 6 == 0) for k in range(400) if k % 2 == 0}
    docs = spark.createDataFrame(rows, SCHEMA)
    index = toxicity.train(docs, spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    bags = {i: plain_terms(t) for i, t in rows}
    df = Counter(b for bag in bags.values() for b in bag)
    examples, y = index.ids.tolist(), [labels[i] for i in index.ids.tolist()]
    assert examples == sorted(examples) and index.labels.tolist() == y and len(examples) > 40
    n = [y.count(0), y.count(1)]

    def weight(b):
        p = [(sum(b in bags[i] for i, own in zip(examples, y) if own == label) + 0.5) / (n[label] + 1) for label in (0, 1)]
        m = sum(p) / 2
        info = sum(q * math.log(q / m) + (1 - q) * math.log((1 - q) / (1 - m)) for q in p) / 2
        return (math.log((1 + len(rows)) / (1 + df[b])) + 1) * (1 + toxicity.GAIN * math.sqrt(max(0, info)))

    weights = {b: weight(b) for b in df}

    def vector(bag):
        v = {b: (1 + math.log(k)) * weights[b] for b, k in bag.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / length for b, x in v.items()}

    table = [vector(bags[i]) for i in examples]
    for i, _ in rows:
        v = vector(bags[i])
        cosine = np.array([sum(x * e.get(b, 0) for b, x in v.items()) for e in table])
        near = [k for k in np.lexsort((np.arange(len(table)), -np.round(cosine, 12)))[: toxicity.NEIGHBOURS] if cosine[k] > 0]
        assert [e.example for e in got[i].evidence] == [examples[k] for k in near] and np.allclose([e.cosine for e in got[i].evidence], cosine[near])
        w = [cosine[k] / (1.05 - min(1, cosine[k])) for k in near]
        share = min(max((sum(x for x, k in zip(w, near) if y[k]) + index.prior) / (sum(w) + 1), 1e-4), 1 - 1e-4)
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-(index.scale * math.log(share / (1 - share)) + index.shift))), rel_tol=1e-6)
        assert got[i].predicted == (got[i].score >= 0.7)


def test_calibration_follows_the_true_shares():
    rng = np.random.default_rng(3)
    raw = np.concatenate((rng.normal(-1, 1, 2000), rng.normal(1, 1, 2000)))
    y = np.repeat([0, 1], 2000)
    scale, shift = calibrated(raw, y, np.where(y == 1, 1.0, 19.0))  # in truth one row in twenty
    x = np.concatenate((rng.normal(-1, 1, 19000), rng.normal(1, 1, 1000)))
    assert abs((1 / (1 + np.exp(-scale * x - shift))).mean() - 0.05) < 0.01


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    taught = labels.join(docs.where("not held").select("doc_id"), "doc_id")
    index = toxicity.train(docs, taught)
    got = toxicity.score(docs.where("held").join(labels, "doc_id"), index).select("toxic", "predicted", "score").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.85 and got[got.toxic == 0].predicted.mean() < 0.02 and got.score.between(0, 1).all()


def test_toxicity_takes_odd_rows(spark, docs):
    index = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    got = toxicity.score(docs, index).collect()
    assert len(got) == len(odd_rows()) and len({r.score for r in got}) == 1
    assert toxicity.score(empty(spark), index).count() == 0


# Mixing
def test_mixing_reaches_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = mixing.train(docs, queries.domain_labels(spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))
    members = mixing.posteriors(docs, model).drop("text").persist()
    for least, growth, targets in ((0.0, 1.0, {"good": 0.9, "poor": 0.07, "toxic": 0.03}), (1.0, 1.5, {"good": 0.8, "poor": 0.15, "toxic": 0.05})):
        got = mixing.fit_rates(members, targets, growth=growth, min_rate=least, most_gap=None).toPandas()
        p = got[[f"p_{d}" for d in model.domains]].to_numpy()
        assert np.allclose(p.sum(axis=1), 1) and got.rate.min() >= least
        w = got.n_tokens.to_numpy() / got.n_tokens.sum()
        t = growth * np.array([targets[d] for d in model.domains])
        assert np.abs((p * (w * got.rate.to_numpy())[:, None]).sum(axis=0) - t).max() < 0.01
        # no feasible step of the objective's gradient changes the rates: they are the least-squares solution
        m = (p * w[:, None]).T @ p + 1e-6 * np.eye(len(t))
        slope = p @ np.linalg.solve(m, (p * (w * got.rate.to_numpy())[:, None]).sum(axis=0) - t) + 1e-6 * (got.rate.to_numpy() - 1)
        assert np.abs(np.maximum(least, got.rate.to_numpy() - slope) - got.rate.to_numpy()).max() < 0.05


def test_mixing_fits_soft_members_and_says_when_it_cannot(spark):
    p = np.random.default_rng(5).dirichlet([9.0, 0.7, 0.3], 2000)
    members = spark.createDataFrame([(k, 100 + k % 50, *map(float, x), 12345.0) for k, x in enumerate(p)], "doc_id bigint, n_tokens bigint, p_a double, p_b double, p_c double, p_zip double").persist()
    for targets in ({"a": 0.6, "b": 0.2, "c": 0.2}, {"a": 5.0, "b": 3.0, "c": 2.0}):
        found = mixing.find_rates(members, targets, most_gap=1e-3)
        got = mixing.fit_rates(members, targets, most_gap=1e-3).toPandas()
        shares = (got[["p_a", "p_b", "p_c"]].to_numpy() * (got.n_tokens * got.rate).to_numpy()[:, None]).sum(axis=0)
        assert got.rate.min() >= 0 and found.gap < 1e-3
        assert np.allclose(shares / shares.sum(), np.array(list(targets.values())) / sum(targets.values()), atol=1e-3)
    with pytest.raises(RuntimeError, match="misses its target"):
        mixing.find_rates(members, {"a": 0.0, "b": 0.0, "c": 1.0}, min_rate=1.0)


def test_mixing_posteriors_are_those_of_naive_bayes(spark, docs):
    labels = {k: "ab"[k % 2] for k in range(8)}
    model = mixing.train(docs, spark.createDataFrame(list(labels.items()), "doc_id bigint, domain string"))
    bucket = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) >> (64 - mixing.BITS)
    counts = {d: Counter(bucket(w) for i, t in odd_rows() if labels.get(i) == d for w in WORD.findall(t)) for d in "ab"}
    for r in mixing.posteriors(docs.withColumns({"b": F.lit(1), "t": F.lit(2), "s0": F.lit(3)}), model).collect():
        words = WORD.findall(r.text or "")
        scale = max(1, len(words)) ** (mixing.TEMPER - 1)
        logs = [math.log(0.5) + scale * sum(math.log((counts[d][bucket(w)] + mixing.SMOOTHING) / (sum(counts[d].values()) + mixing.SMOOTHING * 2**mixing.BITS)) for w in words) for d in "ab"]
        assert math.isclose(r.p_a, 1 / (1 + math.exp(min(700, logs[1] - logs[0]))), rel_tol=1e-6, abs_tol=1e-9) and (r.b, r.t, r.s0) == (1, 2, 3)


def test_mixing_takes_odd_rows(spark, docs):
    labels = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(8)] + [(None, "a"), (9, None)], "doc_id bigint, domain string")
    model = mixing.train(docs, labels)
    got = mixing.fit_rates(mixing.posteriors(docs, model), {"a": 1, "b": 3}).collect()
    assert len(got) == len(odd_rows()) and all(r.rate == 1 for r in got if not r.n_tokens)
    assert mixing.fit_rates(mixing.posteriors(empty(spark), model), {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.train(docs, labels.limit(0))


# Language model
def test_lm_base_is_exact_and_the_net_does_better(spark):
    rows = odd_rows() + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, SCHEMA)
    train = docs.where("coalesce(doc_id, 0) % 7 <> 2")
    model, counts = lm.train(train)
    got = {(r.doc_id, r.text_copy): r for r in lm.score(docs.withColumn("text_copy", F.col("text")).withColumn("score", F.lit("x")), model, counts).collect()}
    c = Counter()
    for i, t in rows:
        if (i or 0) % 7 != 2:
            c.update((t or "").encode().lower().split())
            c[b"\n"] += 1
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b"\n"]
        r = got[i, t]
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in c for w in words), n) and r.score < 0
    held = [r for (i, _), r in got.items() if i is not None and i % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_scores_are_those_of_a_plain_loop(spark):
    rng = random.Random(12)
    rows = [(k, prose(rng, rng.choice([1, 3, 40, 200]))) for k in range(30)] + [(40, None), (41, ""), (42, prose(rng, 9000)), (43, "unseen zebra")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model, counts = lm.train(docs.where("doc_id < 25"))
    c = Counter(w for i, t in rows if i < 25 for w in [*(t or "").encode().lower().split(), b"\n"])
    m, end = model, int(model.output[model.head[b"\n"]])
    for r in lm.score(docs.withColumn("original", F.col("text")), model, counts).collect():
        h, x, total = np.zeros((1, lm.HIDDEN), np.float32), end, 0.0
        for w in [*(r.original or "").encode().lower().split(), b"\n"]:
            h, *_ = lm._step(m.net, np.array([x]), h)
            x = int(m.output[m.head[w]]) if w in m.head else m.frequent + lm._rest(w)
            total += float(lm._log_probability(m.net, h, np.array([x]))[0]) / math.log(10)
            if x >= m.frequent:
                total += math.log10((c[w] + 1) / (m.rest_total[x - m.frequent] + m.rest_types[x - m.frequent] + 1))
        assert math.isclose(r.score, total, rel_tol=1e-4)


def test_lm_learns_every_token_and_nothing_from_nothing(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "_gradient", lambda net, x, y, fresh, h0, out: (seen.append((x, y, fresh)), h0)[1])
    texts = [np.array([*range(1, n), 0]) for n in (1, 2, 60, 25, 24, 500)] * 40
    lm._trained(lm._start(lm.Model(1, 1, {}, 1, np.ones(600, np.int64), np.arange(600), np.zeros(lm.REST), np.zeros(lm.REST))), texts, 0, 0.01)
    assert sum((y >= 0).sum() for _, y, _ in seen) == sum(map(len, texts)) and sum((f & (y >= 0)).sum() for _, y, f in seen) == len(texts)
    assert all((x[(y > 0) & ~f] == y[(y > 0) & ~f] - 1).all() for x, y, f in seen)
    model, counts = lm.train(empty(spark))
    got = lm.score(spark.createDataFrame([(1, "some words"), (2, None)], SCHEMA), model, counts).collect()
    assert all((r.base_score, r.n_known, r.train_tokens) == (0.0, 0, 0) and r.score < 0 for r in got)


def test_lm_probabilities_sum_to_one_and_gradient_is_right():
    words = [(b"\n", 50)] + [(b"w%d" % k, 40 - k // 10) for k in range(300)]
    first = 128
    output = np.array([k if k < first else first + lm._rest(w) for k, (w, _) in enumerate(words)])
    rest = [lm._rest(w) for w, _ in words[first:]]
    totals = np.bincount(rest, [n for _, n in words[first:]], minlength=lm.REST), np.bincount(rest, minlength=lm.REST).astype(float)
    m = lm.Model(1, 1, lm._Head((w, k) for k, (w, _) in enumerate(words)), 1, np.array([n for _, n in words]), output, *totals)
    small = lm.Net(*(np.random.default_rng(1).normal(0, 0.3, s).astype(np.float64) for s in ((128 + lm.REST, 48), (16, 48), (16, 2 + lm.REST), (2 + lm.REST,), (2, 16, 64), (2, 64))))
    h = np.random.default_rng(2).normal(0, 1, (5, lm.HIDDEN))
    every = np.arange(128 + lm.REST)
    p = np.stack([np.exp(lm._log_probability(small, np.repeat(x[None], len(every), 0), every)) for x in h])
    assert np.allclose(p.sum(axis=1), 1)
    del m
    x, y = np.random.default_rng(3).integers(0, 128, (2, 3, 5))
    y[0, 4] = -1
    fresh, h0 = np.zeros((3, 5), bool), np.random.default_rng(4).normal(0, 1, (3, lm.HIDDEN))
    fresh[1, 2] = fresh[2, 0] = True  # texts that begin in a lane

    def loss(net):
        h, total = h0, 0.0
        for t in range(5):
            h, *_ = lm._step(net, x[:, t], h * ~fresh[:, t, None])
            ok = y[:, t] >= 0
            total -= lm._log_probability(net, h[ok], y[ok, t]).sum()
        return total / (y >= 0).sum()

    small = small.like(small.flat())
    g = small.like(np.zeros(small.flat().size))
    lm._gradient(small, x, y, fresh, h0, g)
    flat, own = small.flat().astype(np.float64), g.flat()
    for k in [int(i) for i in np.argsort(-np.abs(own))[:12]]:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert math.isclose((loss(small.like(up)) - loss(small.like(down))) / 2e-2, own[k], rel_tol=0.05, abs_tol=1e-3)


# Media
def _tune(rng, n=64):
    hz = np.repeat(220 * 2 ** (rng.integers(0, 24, n) / 12), 256)
    return np.sin(2 * np.pi * np.cumsum(hz) / media.RATE)


def _wav(x):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(media.RATE)
        w.writeframes((np.clip(x, -1, 1) * 20000).astype("<i2").tobytes())
    return bytearray(out.getvalue())


def test_media_aligns_shifted_and_noisy_recordings(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        t = _tune(rng)
        shift = 128 * int(rng.integers(1, 20))
        rows += [(3 * k, _wav(t)), (3 * k + 1, _wav(np.concatenate((rng.normal(0, 0.1, shift), t)) + rng.normal(0, 0.02, len(t) + shift))), (3 * k + 2, _wav(t[32 * 128 :] * 0.5))]
    rows += [(500, None), (501, bytearray(b"x")), (502, rows[0][1]), (None, rows[3][1])]
    got = {r.media_id: r for r in media.align(media.with_fingerprint(spark.createDataFrame(rows, "media_id bigint, audio binary"))).collect()}
    own = [r for k, r in got.items() if k is not None and k < 500]
    assert sum(r.n_links for r in own) >= 0.9 * 240  # of three pairs a tune, each counted at both ends
    assert all(r.best_match // 3 == r.media_id // 3 and r.n_links <= 2 for r in own if r.n_links)
    assert got[502].class_id == 0 and got[None].class_id == 3 and got[500].n_prints == got[501].n_prints == 0 and got[500].n_links == 0


def test_media_finds_what_brute_force_finds(spark):
    """The query's own recordings and close copies, against all offsets of all pairs."""
    rng = np.random.default_rng(4)
    some = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding is not null").orderBy("vec_id").limit(120).collect()]
    rows = [(k, list(map(float, v))) for k, v in enumerate(some)] + [(1000 + k, [float(x) for x in np.asarray(v) + rng.normal(0, 0.02, len(v))]) for k, v in enumerate(some)]
    marked = written(media.with_fingerprint(queries.recordings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))))
    prints = {r.media_id: np.array(r.fingerprint, np.int32).view(np.uint32) for r in marked.collect()}

    def error(x, y, offset):
        begin, end = max(0, -offset), min(len(x), len(y) - offset)
        return int(np.bitwise_count(x[begin:end] ^ y[begin + offset : end + offset]).sum()) / (32 * (end - begin)) if end - begin >= 24 else 1.0

    copies = [k for k in range(len(some)) if error(prints[k], prints[1000 + k], 0) <= 0.25]
    assert len(copies) >= 0.9 * len(some)
    got = {r.media_id: r for r in media.align(marked).collect()}
    assert sum(got[1000 + k].best_match == k for k in copies) >= 0.9 * len(copies)
    for k, r in got.items():
        assert r.n_links == 0 or r.bit_error == (error(prints[k], prints[r.best_match], r.offset)) <= 0.25


def test_media_links_at_a_repeated_passage(spark):
    """The beginning of a passage comes twice in one recording: each place votes and each offset is tried."""
    notes = np.random.default_rng(6).integers(-(1 << 31), 1 << 31, 140).astype(int).tolist()
    part, tail, between = notes[:40], notes[40:80], notes[80:]
    rows = [(1, part + tail), (2, part[:36] + between + part + tail[:5])]
    got = {r.media_id: r for r in media.align(spark.createDataFrame(rows, "media_id bigint, fingerprint array<int>")).collect()}
    assert (got[1].best_match, got[1].offset, got[1].bit_error) == (2, 96, 0.0)


def test_media_on_short_and_silent_audio():
    assert len(media.fingerprint(bytes(_wav(np.zeros(300))))) == 0
    assert len(media.fingerprint(bytes(_wav(np.zeros(media.FRAME + 20 * media.HOP))))) == 6


def test_crc_of_ids(spark):
    from pagesim.llm.common import crc_mod

    got = spark.range(50).select("id", crc_mod(F.col("id"), 7).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 7 for r in got)
    assert pd.notna(got[0].m)


def test_media_votes_in_small_parts(monkeypatch):
    """Parts of fewer votes than a recording has give the same offsets, each once, as a plain count."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 32, 90, dtype=np.uint32)
    prints = [np.roll(base, k)[: 60 + k] for k in range(8)] + [np.full(70, 5, np.uint32), np.full(66, 5, np.uint32)]
    flat, size = np.concatenate(prints), np.array([len(p) for p in prints])
    votes = {}
    for band in media.BANDS:
        keys = [[tuple(p[t + k] >> band & 255 for k in (0, *media.AHEAD)) for t in range(len(p) - media.AHEAD[-1])] for p in prints]
        for a in range(len(prints)):
            for b in range(a + 1, len(prints)):
                for i, x in enumerate(keys[a]):
                    for j, y in enumerate(keys[b]):
                        if x == y:
                            votes[a, b, j - i] = votes.get((a, b, j - i), 0) + 1
    want = sorted(k for k, n in votes.items() if n >= 2)
    every, some = np.ones(len(prints), bool), np.arange(len(prints)) % 3 == 0
    for parts in (1 << 18, 40):
        monkeypatch.setattr(media, "VOTES", parts)
        got = sorted(tuple(map(int, x)) for found in media._offsets(flat, size, every, every, 2) for x in zip(*found))
        assert got == want
        got = sorted(tuple(map(int, x)) for found in media._offsets(flat, size, some, ~some, 2) for x in zip(*found))
        assert got == [x for x in want if some[x[0]] != some[x[1]]]
