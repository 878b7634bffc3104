"""Pairs without copies of their pages, joins or broadcasts that grow, at the edges of blocks."""

import random
import re

import pytest

from pagesim import queries
from pagesim.operators import pairs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["block_overlap_pairs", "tfidf_cosine_pairs", "trigram_jaccard_pairs", "ci_gate", "clean_view_pairs", "jaccard_prefix_pairs", "p1_top20", "pairs_classified", "trigger_reasons", "trigger_flags", "pairs_scored", "priority_counts", "duplicate_statistics", "most_duplicated_top5"])
def test_pages_are_not_copied_or_broadcast(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CartesianProduct") == 1
    below = plan[plan.index("CartesianProduct") :].split("Subquery")[0]  # the common blocks are a query of their own
    assert "Generate" not in below
    assert not re.search("BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|CoGroup", plan)


def plain(own, other, powers):
    a, b = ({v: x.count(v) for v in x} for x in (own, other))
    return sum(a[v] ** powers[0] * b[v] ** powers[1] for v in a if v in b)


@pytest.mark.parametrize("block", [1, 3, 7, 100])
def test_overlaps_of_blocks_of_any_size(spark, block):
    rng = random.Random(block)
    rows = []
    for k in rng.sample(range(1000), 20):  # keys that are not in order
        t = [rng.choice([1, 1, 1, 2, 3, rng.randrange(40)]) for _ in range(rng.randrange(0, 30))]
        rows.append((k, sorted({rng.randrange(-9, 9) for _ in range(rng.randrange(0, 9))}), t, sorted(set(t))[:3]))
    feats = spark.createDataFrame(rows, "k bigint, g array<bigint>, t array<bigint>, b array<bigint>")
    got = {(r.k1, r.k2): r for r in pairs.overlaps(feats, block).collect()}
    assert len(got) == 20 * 19 // 2
    own = {r[0]: r for r in rows}
    for (i, j), r in got.items():
        a, b = own[i], own[j]
        assert i < j and (r.g, r.b) == (len({*a[1]} & {*b[1]}), len({*a[3]} & {*b[3]}))
        assert (r.d, r.s1, r.s2) == tuple(plain(a[2], b[2], p) for p in ((1, 1), (2, 0), (0, 2)))
        assert (r.n_g1, r.n_g2, r.n_b1, r.n_b2) == (len(a[1]), len(b[1]), len(a[3]), len(b[3]))
        assert (r.n_t1, r.n_t2) == (plain(a[2], a[2], (2, 0)), plain(b[2], b[2], (2, 0)))


def test_counts_too_large_for_single_precision(spark):
    rows = [(0, [5] * 6000 + [6]), (1, [5] * 5000 + [7]), (2, [6, 7])]
    got = {(r.k1, r.k2): (r.d, r.s1, r.s2) for r in pairs.overlaps(spark.createDataFrame(rows, "k bigint, t array<bigint>"), of="t").collect()}
    assert got == {(0, 1): (30_000_000, 36_000_000, 25_000_000), (0, 2): (1, 1, 1), (1, 2): (1, 1, 1)}


def test_hashes_and_urls_come_with_their_pairs(spark):
    rows = [(k, f"u{k}", h, "same words", ["same words"], ["same"] if k % 2 else []) for k, h in ((7, "x"), (3, "y"), (5, "x"), (1, ""), (2, ""))]
    table = spark.createDataFrame(rows, "page_id bigint, url string, sha256 string, main_content string, blocks array<string>, clean_blocks array<string>")
    common = spark.createDataFrame([("words", 5)], "block string, df bigint")
    for block in (2, 512):
        got = {(r.k1, r.k2): r for r in pairs.score_pairs(table, common, block=block).collect()}
        assert len(got) == 10 and all((r.url1, r.url2) == (f"u{i}", f"u{j}") for (i, j), r in got.items())
        assert {k for k, r in got.items() if r.sha256_match} == {(5, 7), (1, 2)}
        assert {k for k, r in got.items() if r.tfidf_cosine_clean is not None} == {k for k in got if k[0] % 2 and k[1] % 2}
        own = {(r.k1, r.k2) for r in pairs.score_pairs(table, ignore_empty_hash=True, block=block).collect() if r.sha256_match}
        assert own == {(5, 7)}
    assert "url1" not in pairs.score_pairs(table, urls=False).columns
    some = pairs.score_pairs(table, common.limit(0), raw=False, block=2)
    assert some.count() == 10 and some.where("tfidf_cosine_clean is not null").isEmpty() and "tfidf_cosine" not in some.columns


@pytest.mark.parametrize("block", [1, 4, 100])
@pytest.mark.parametrize("percent", [30, 70, 100])
def test_blocks_too_unlike_in_size_do_not_meet_and_lose_no_pair(spark, block, percent):
    rng = random.Random(percent)
    sets = [{rng.randrange(30) for _ in range(rng.randrange(0, 40))} for _ in range(40)]
    sets += sets[:3] + [set(range(10)), set(range(7))]  # 70 % exactly
    feats = spark.createDataFrame([(k, sorted(x)) for k, x in enumerate(sets)], "k bigint, g array<bigint>")
    got = {(r.k1, r.k2): (r.g, r.n_g1, r.n_g2) for r in pairs.jaccard_above(feats, percent, block).collect()}
    want = {(i, j): (len(x & y), len(x), len(y)) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if (x | y) and len(x & y) * 100 >= len(x | y) * percent}
    assert got == want and want


def test_measures_are_columns_once_for_flags(spark):
    """The square roots of the cosine stood in the plan once for each threshold that it is held against."""
    plan = queries.QUERIES["trigger_flags"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("SQRT(") <= 2
