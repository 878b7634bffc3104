import hashlib

import corpus_pipeline as P
from pagesim.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, seen = docs.count(), []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF).persist()
        seen.append((name, docs.count()))
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
            kept = docs
    counts = dict(seen)
    assert [x for x, _ in seen] == ["language ID", "line dedup", "near-dedup", "mixing", "BPE"]
    assert counts["language ID"] >= 0.98 * n and counts["near-dedup"] <= counts["line dedup"] <= counts["language ID"] and counts["mixing"] >= counts["near-dedup"]
    assert kept.select("doc_id").distinct().count() == counts["near-dedup"]
    texts = {r.doc_id: r.text for r in kept.collect()}
    tokenizers = __import__("tokenizers").Tokenizer.from_file(queries.vocabulary_path())
    for r in docs.limit(50).collect():
        assert r.ids == tokenizers.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_takes_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_mixing_meets_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*P.COLUMNS)
    model = mixing.train(docs, queries.domain_labels(spark.read.parquet(f"{sf}/labels.parquet")))

    def shares(rows):
        return mixing.shares(mixing.posteriors(rows, model).persist(), model.domains)

    mixed = P.mix_domains(spark, docs, sf).persist()
    before, after = shares(docs), shares(mixed)
    assert all(abs(after[d] - before[d] / P.GROWTH) < 0.01 for d in P.LESS)
    assert mixed.dropDuplicates(["doc_id", "text"]).count() == docs.dropDuplicates(["doc_id", "text"]).count()


def test_stages_take_odd_rows(spark, tmp_path):
    long = " ".join(f"word{k % 700}" for k in range(60_000))
    rows = [(1, None, "en", None, None, "x"), (1, None, "en", None, None, "x"), (None, "Some words of a line", None, "s", 3, "y"), (2, "", "en", "s", 0, "z"), (2, long, "en", "s", 9, "z"), (2, "Another text under that id\nwith lines", "en", "s", 9, "z"), (3, " \t\n", "en", "s", 9, "z")]
    docs = spark.createDataFrame(rows * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint, gone string")
    spark.createDataFrame([(2, 1, 0), (1, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in P.STAGES:
        got = stage(spark, docs, str(tmp_path)).collect()
        if name in ("mixing", "BPE"):
            assert len(got) >= len(rows) * 2
        elif name == "line dedup":
            assert sorted({r.doc_id or 0 for r in got}) == [0, 2] and all(r.text for r in got)
        elif name == "near-dedup":
            assert len(got) == len({r.text for r in got}) and sum(not (r.text or "").strip() for r in got) == 1
        else:
            assert all(r.text.strip() for r in got)
