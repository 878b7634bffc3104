"""Queries opN_* over the corpus tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, linedup, lm, media, mixing, quality, simhash, substring, toxicity
from .common import crc_mod, read_table, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)
    labels = read_table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", "held_out", "score", "predicted", "evidence")


#: Domains from the labels, and the share of all tokens that each is to have.
MIX_TARGETS = {"good": 0.92, "poor": 0.06, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, domain_labels(read_table(spark, sf_dir, "labels")))
    members = written(mixing.posteriors(docs, model).drop("text"), "members")
    rated = mixing.fit_rates(members, MIX_TARGETS)
    return rated.withColumn("copies", mixing.copies(F.col("rate"), F.col("doc_id")))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)
    model, counts = lm.train(docs.where("not held_out"))
    return lm.score(docs, model, counts)


def op4_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.dedupe_lines(docs).select("doc_id", "n_removed", "n_similar", F.length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or vocabulary_path()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, path, decoded="decoded")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring.dedupe(docs)

    def total(spans: str):
        return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["begin"])

    return found.select("doc_id", (F.size("shared_spans") > 0).alias("has_repeat"), F.size("removed_spans").alias("n_spans"), total("shared_spans").alias("shared_bytes"), total("removed_spans").alias("removed_bytes"), F.sha2("deduped", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def _played(vector: list[float] | None, note: int = 256) -> bytes | None:
    """A WAV file that plays each component of a vector as a tone: within two octaves from 220 Hz, by its size."""
    if vector is None:
        return None
    pitch = np.floor(np.clip(np.nan_to_num(np.asarray([v or 0.0 for v in vector])) * 32 + 12, 0, 23))
    hz = np.repeat(220 * 2 ** (pitch / 12), note)
    x = np.sin(2 * np.pi * np.cumsum(hz) / media.RATE)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(media.RATE)
        w.writeframes((x * 20000).astype("<i2").tobytes())
    return out.getvalue()


def recordings(embeddings: DataFrame) -> DataFrame:
    """media_id and audio: each vector of the table as a recording, a few rows a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((_played(x.as_py()) for x in part.column(1)), pa.binary())], names=["media_id", "audio"])

    return embeddings.select(F.col("vec_id").alias("media_id"), "embedding").mapInArrow(run, "media_id bigint, audio binary")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = recordings(read_table(spark, sf_dir, "embeddings"))
    marked = written(media.with_fingerprint(audio), "fingerprints")
    return media.align(marked).withColumnRenamed("media_id", "vec_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_lm": op3_lm,
    "op4_linedup": op4_linedup,
    "op5_bpe": op5_bpe,
    "op6_substring": op6_substring,
    "op7_simhash": op7_simhash,
    "op8_langid": op8_langid,
    "op9_media": op9_media,
    "op10_quality": op10_quality,
}

_LINES = r"""
WITH li AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
cl AS MATERIALIZED (SELECT s, row_number() OVER () AS id, f FROM (SELECT s, min((doc_id, line)) AS f FROM li WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY s)),
st AS MATERIALIZED (SELECT id, list_distinct(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS w FROM cl),
tk AS MATERIALIZED (SELECT id, unnest(w) AS w, len(w) AS n FROM st),
df AS (SELECT w, count(*) AS c FROM tk GROUP BY w),
pf AS MATERIALIZED (SELECT id, w, n FROM (SELECT id, tk.w, n, row_number() OVER (PARTITION BY id ORDER BY c, tk.w) AS p FROM tk JOIN df USING (w)) WHERE p <= n - (n * 800 + 999) // 1000 + 1),
ca AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pf a JOIN pf b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 8),
lk AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, len(list_intersect(x.w, y.w)) AS i, len(x.w) + len(y.w) AS t FROM ca JOIN st x ON x.id = a JOIN st y ON y.id = b) WHERE i * 1800 >= t * 800),
ar AS (SELECT e.id, min(f) AS f FROM (SELECT a AS id, b AS other FROM lk UNION ALL SELECT b, a FROM lk) e JOIN cl ON cl.id = e.other GROUP BY e.id),
ju AS (SELECT s, cl.f, coalesce(ar.f < cl.f, false) AS near FROM cl LEFT JOIN ar USING (id)),
pl AS (SELECT doc_id, line, li.s, coalesce((doc_id, line) > f, false) AS repeats, coalesce(near, false) AS near FROM li LEFT JOIN ju ON li.s = ju.s),
ou AS (SELECT doc_id, count(*) FILTER (repeats OR near) AS n_removed, count(*) FILTER (near AND NOT repeats) AS n_similar, coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (NOT repeats AND NOT near), '') AS t FROM pl GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_similar, 0) AS n_similar, length(t) AS kept_chars, sha256(t) AS kept_sha256 FROM documents d LEFT JOIN ou ON d.doc_id = ou.doc_id
"""

ORACLES: dict[str, str] = {"op4_linedup": _LINES}
