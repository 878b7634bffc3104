"""A training corpus from documents: language ID, line dedup, near-dedup, mixing and BPE, each over all rows it gets."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesim.llm import bpe, langid, linedup, mixing, queries, simhash
from pagesim.llm.common import dropped, read_table, shared_folder, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Tokens grow by this share in all, and the domains in LESS are to have their present share divided by it: that can be
#: met without dropping a document.
GROWTH, LESS = 1.25, ("poor", "toxic")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a learned language's centroid accepts; null texts and texts without a letter go.

    Rows without a language teach nothing and are judged like others; repeated rows are judged alike.
    """
    model = langid.train(docs.select("text", "lang"))
    return langid.predict(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; documents of which nothing is left go, null texts too.

    Null ids come first in the order of lines; repeated rows share their places and stay alike.
    """
    kept = linedup.dedupe_lines(docs.select(*COLUMNS)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; null and empty texts are one group."""
    return simhash.keep_first(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at the rates that bring the domains' tokens to their targets; every document stays.

    Documents without words stay once; documents without id are repeated alike. Missed targets give a warning.
    """
    model = mixing.train(docs, queries.domain_labels(read_table(spark, sf_dir, "labels")))
    members = written(mixing.posteriors(docs.select(*COLUMNS), model), "members")
    targets = mixing.shares(members, model.domains)
    rest = [d for d in targets if d not in LESS]
    if rest and len(rest) < len(targets):
        less = {d: x / GROWTH for d, x in targets.items() if d in LESS}
        kept = sum(targets[d] for d in rest)
        targets = {d: less[d] if d in LESS else targets[d] / kept * (1 - sum(less.values())) for d in targets}
    rates = mixing.find_rates(members, targets, growth=GROWTH, min_rate=1.0, most_gap=None)
    if rates.gap > 0.005:
        warnings.warn(f"a domain's share misses its target by {rates.gap:.4f}: {rates.shares}", stacklevel=2)
    times = mixing.copies(rates.of(members), F.col("doc_id"))
    return members.select(*COLUMNS, F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (null: none), and the digests of ids and decoded text; repeated rows are encoded alike."""
    path = queries.vocabulary_path()
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded")
    return bpe.digests(coded).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedupe_lines),
    ("near-dedup", dedupe_documents),
    ("mixing", mix_domains),
    ("BPE", encode),
]

#: Classifiers, fingerprints by XXH64 and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; the tables of a stage go once the next one's stands."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            dropped(before)
        docs = before = spark.read.parquet(path)
    return docs
