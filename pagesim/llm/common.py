"""Helpers shared by the corpus operators: reading, whole-text words, shared-folder tables, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only where none is set and all is one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pagesim-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of what runs inside as soon as it has ended: nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` gave and that nothing reads again."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def key_filter(keys: DataFrame, most_bits: int = 27) -> DataFrame:
    """One row: an array of words of 64 bits with a bit for each hash value that some row of keys (`id`, bigint) has.

    There are about 16 bits a key and 2**most_bits at most. The word is told by the lowest bits of the key, the bit by its
    top six. It only spares moving rows whose key cannot be there; what it lets through still has to be joined.
    """
    words = 1 << (min(most_bits, max(16, (16 * keys.count()).bit_length())) - 6)
    one = keys.select(F.col("id").bitwiseAND(F.lit(words - 1)).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("id", 58).cast("int")).alias("b"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    rows = one.groupBy("w").agg(F.bit_or("b").alias("b")).union(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    rows = rows.groupBy(F.shiftright("w", 10).alias("hi")).agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("r"))
    return rows.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("hi", F.col("r.b").alias("b")))), lambda x: x["b"])).alias("bits"))


def maybe_in(bits: Column, key: Column) -> Column:
    """False where the key surely is not among those of the filter."""
    word = F.get(bits, key.bitwiseAND((F.size(bits) - 1).cast("bigint")).cast("int"))
    return F.call_function("shiftrightunsigned", word, F.shiftrightunsigned(key, 58).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


#: Keys with over 1 / HOT of the rows (fewer than HOT of them) are dealt into SALTS parts.
HOT, SALTS = 256, 64


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], times: str, by: str) -> DataFrame:
    """rows joined with keys, a written table with a row for each key and in `times` how many rows have it.

    The rows of a key that has many are dealt into SALTS tasks by a hash of their column `by`.
    """
    total = keys.agg(F.sum(times)).first()[0] or 0
    hot = [r[0] for r in keys.where(F.col(times) > total / HOT).select(on[0]).collect()]  # fewer than HOT by the sum
    if not hot:
        return rows.join(keys.drop(times), on)
    many = F.col(on[0]).isin(hot)
    (salt,) = free_names(rows, "salt")
    dealt = rows.withColumn(salt, F.when(many, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int"))
    each = keys.drop(times).withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(many, SALTS - 1).otherwise(0))))
    return dealt.join(each, [*on, salt]).drop(salt)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    """Words of a text (null: none) without Python."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(rows: DataFrame, label: str, per_label: int, by: list[str]) -> DataFrame:
    """Up to per_label distinct rows (label, *by) of each label: those with the least hash of `by`.

    A label's rows are counted first (labels are few), and only those whose hash lies below twice the share wanted are
    ranked, so about 2 * per_label rows of a label meet, however many there are.
    """
    once = rows.groupBy(label, *by).agg(F.count("*").alias("_times")).drop("_times")
    hashed = once.withColumn("_hash", F.xxhash64(*by))
    counts = hashed.groupBy(label).agg(F.count("*").alias("_n")).collect()
    most = (1 << 63) - 1
    limit = F.coalesce(*(F.when(F.col(label).eqNullSafe(F.lit(r[0])), F.lit(min(most, -most + 2 * most * (2 * per_label + 100) // r[1]))) for r in counts), F.lit(most))
    order = Window.partitionBy(label).orderBy("_hash", *by)
    return hashed.where(F.col("_hash") <= limit).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_label).drop("_rank", "_hash")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star rounds; each round only groups and joins, its edges are written to the
    shared folder, and the driver sees one count and one checksum. Empty edges give an empty result.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        down = down.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").union(stars.select(F.col("component").alias("node"), "component").distinct())
