import math
import random
import re
import unicodedata
from collections import Counter
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagesim.functions import policy
from pagesim.functions import text as X
from pagesim.functions import urls as U
from pagesim.operators import classify, css, pairs

TEXTS = ["", "ab", "abc", "A b　c\x85d", "ｆｕｌｌ　ｗｉｄｔｈ ﬁ", "漢字 かな カナ 한글", "emoji 😀 b😀c", "c_ñ x-y 12½", "line\n\nline  two\tx", "İΑΣ", "・中黒"]


def run(spark, values, expr):
    table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [r.x for r in table.select("k", expr(F.col("t")).alias("x")).orderBy("k").collect()]


def test_text_functions_follow_unicode_rules(spark):
    assert run(spark, TEXTS, X.nfkc) == [unicodedata.normalize("NFKC", t) for t in TEXTS]
    assert run(spark, TEXTS, X.collapse) == [re.sub(r"\s+", " ", t).strip() for t in TEXTS]
    assert run(spark, TEXTS, X.blocks) == [[re.sub(r"\s+", " ", p.lower()).strip() for p in re.split(r"\n+|\s{2,}", t) if p.strip()] for t in TEXTS]
    assert run(spark, TEXTS, X.has_cjk) == [bool(re.search("[一-鿿぀-ゟ゠-ヿ가-힯]", t)) for t in TEXTS]
    assert run(spark, TEXTS, lambda c: X.word_count(X.collapse(c))) == [len(t.split()) for t in TEXTS]
    assert run(spark, TEXTS, X.tokens) == [re.findall("[\\w一-鿿぀-ゟ゠-ヿ가-힯]+", t.lower()) for t in TEXTS]


def plain_trigrams(t):
    t = re.sub(r"\s+", "", t)
    return {t[k : k + 3] for k in range(len(t) - 2)}


def test_trigrams_are_runs_of_code_points(spark):
    assert [set(x) for x in run(spark, TEXTS, X.trigrams)] == [plain_trigrams(t) for t in TEXTS]
    assert [len(x) for x in run(spark, TEXTS, X.trigram_codes)] == [len(plain_trigrams(t)) for t in TEXTS]


@pytest.mark.parametrize("url, want", [("https://h/a#f", "https://h/a"), ("https://h/a/", "https://h/a"), ("https://h/", "https://h/"), ("https://h", "https://h"), ("https://h/a?q=b/", "https://h/a?q=b"), ("https://h/a;p=1?x=2", "https://h/a?x=2")])
def test_normalized(spark, url, want):
    assert run(spark, [url], U.normalized) == [want]


def test_url_problems(spark):
    got = run(spark, ["http://h/x", "ftp://h", "https:///x", "http://u@h/", "http://h:70000/", "http://h:x/", "", None, "HTTPS://H"], U.problem)
    assert got[0] is None and got[8] is None
    assert [g.split(":")[0] for g in got[1:8]] == ["only http", "URL must include a hostname", "credentials in URLs are not allowed", "invalid URL port", "invalid URL port", "URL must be a non-empty string", "URL must be a non-empty string"]


def test_join_follows_the_standard(spark):
    base = "https://h.example/a/b?x=1#f"
    refs = ["", "/r", "//o/x", "?q=2", "#g", "rel", "http://z/", "mailto:a@b"]
    assert run(spark, refs, lambda c: U.join(F.lit(base), c)) == [base if r == "" else urljoin(base, r) for r in refs]
    dots = ["../x", "./y", "a/../../z"]
    assert run(spark, dots, lambda c: U.join_any(F.lit(base), c)) == [urljoin(base, r) for r in dots]


def test_public_addresses(spark):
    cases = {"8.8.8.8": True, "10.0.0.1": False, "100.64.1.1": False, "::1": False, "2606:4700:4700::1111": True, "::ffff:127.0.0.1": False, "::ffff:8.8.8.8": True, "64:ff9b::a00:1": False, "fe80::1": False, "nope": False, None: False, "224.0.0.1": False}
    assert run(spark, list(cases), policy.public_ip) == list(cases.values())
    v4 = [a for a in cases if a and ":" not in a]
    table = spark.createDataFrame([(a,) for a in v4], "ip string")
    assert {r.ip: r.is_public for r in policy.public_ipv4(table).collect()} == {a: cases[a] for a in v4}


def test_one_bad_answer_rejects_a_host(spark):
    rows = [("a", "8.8.8.8"), ("a", "10.0.0.1"), ("b", "9.9.9.9"), ("b", "8.8.4.4")]
    got = {r.host: (r.accepted, r.connect_to) for r in policy.vetted_hosts(spark.createDataFrame(rows, "host string, address string")).collect()}
    assert got == {"a": (False, None), "b": (True, "8.8.4.4")}


def plain_cosine(a, b):
    a, b = Counter(a), Counter(b)
    if not a or not b:
        return 0.0
    weight = {t: math.log(1 + 2 / ((t in a) + (t in b))) for t in {*a, *b}}
    dot = sum(a[t] * b[t] * w * w for t, w in weight.items())
    sizes = [math.sqrt(sum((c[t] * w) ** 2 for t, w in weight.items())) for c in (a, b)]
    return dot / (sizes[0] * sizes[1])


def test_pair_measures_equal_plain_versions(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(30)]
    pages = []
    for k in range(23):
        blocks = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(0, 6))]
        pages.append((k, f"u{k}", " ".join(blocks), blocks))
    table = spark.createDataFrame(pages, "page_id bigint, url string, main_content string, blocks array<string>").withColumn("sha256", X.sha256(F.col("main_content")))
    got = {(r.k1, r.k2): r for r in pairs.score_pairs(table, block=5).collect()}
    assert len(got) == 23 * 22 // 2
    for (i, j), r in got.items():
        a, b = pages[i], pages[j]
        x, y = plain_trigrams(a[2]), plain_trigrams(b[2])
        assert r.jaccard_3gram == (len(x & y) / len(x | y) if x and y else 0.0)
        assert math.isclose(r.tfidf_cosine, plain_cosine(a[2].split(), b[2].split()), abs_tol=1e-12)
        p, q = set(a[3]), set(b[3])
        assert r.block_overlap == (len(p & q) / min(len(p), len(q)) if p and q else 0.0)
        assert r.sha256_match == (a[2] == b[2]) and r.jaccard_3gram_clean is None
    near = {(r.k1, r.k2) for r in pairs.jaccard_above(pairs.features(table), 30).collect()}
    assert near == {k for k, r in got.items() if r.jaccard_3gram >= 0.3}


def test_priorities_at_the_thresholds(spark):
    rows = [(True, 0.0, 0.0, 0.0), (False, 0.85, 0.0, 0.0), (False, 0.849, 0.7, 0.0), (False, 0.0, 0.699, 0.8), (False, 0.6, 0.0, 0.0), (False, 0.0, 0.4, 0.0), (False, 0.0, 0.0, 0.5), (False, 0.3, 0.0, 0.0), (False, 0.0, 0.2, 0.0), (False, 0.0, 0.0, 0.3), (False, 0.299, 0.199, 0.299)]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, sha256_match boolean, tfidf_cosine double, jaccard_3gram double, block_overlap double")
    got = classify.classified(table).orderBy("k").collect()
    assert [r.priority for r in got] == ["P1"] * 4 + ["P2"] * 3 + ["P3"] * 3 + [None]
    assert got[0].trigger_reasons == ["SHA-256 exact match"] and got[1].trigger_reasons == ["TF-IDF 0.85 >= 0.85"] and got[10].trigger_reasons == []
    assert got[2].trigger_reasons == ["Jaccard 0.70 >= 0.7"]


@pytest.mark.parametrize("selector, want", [("p", "one\n"), ("#b", "two\n"), (".x.y", "three"), ("div > p", "two\n"), ("div p.z, span", "three"), ("[data-k=v]", "two\n"), ("p + p", None), ("div ~ span", "three"), ("p:first-child", "two\n"), ("nope", None)])
def test_selectors(selector, want):
    html = "<body><h1>t</h1><p>one<div><p id=b data-k=v>two</div><span class='x y'>three</span></body>"
    got = css.select_text(html, selector)
    assert (got if got is None else got.strip()) == (want if want is None else want.strip())
