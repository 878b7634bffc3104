"""Breadth-first crawl of a link graph, a level at a time."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def _written(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared checkpoint folder, or in one of its own where none is set and all is one process."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pagesim-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/crawl-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def next_frontier(edges: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """URLs that the frontier links to and that have not been seen, each once."""
    return edges.join(frontier.select(F.col("url").alias("src_url")), "src_url").select(F.col("dst_url").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")


def crawl(edges: DataFrame, seeds: DataFrame, max_pages: int = 200, follow_external: bool = False, pages: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """url, depth of the pages reached from seeds (url) over edges (src_url, dst_url).

    pages (url): those that answered; only they count and are expanded, all do if not given. verdicts (url, allowed):
    what robots files say. Links lead to other sites only with follow_external. At most max_pages count; within the
    last level the first URLs in order do. The driver sees one count a level.
    """
    ok = U.problem(F.col("dst_url")).isNull() & U.crawlable_ending(F.col("dst_url"))
    links = edges.where(ok if follow_external else ok & U.same_site(F.col("src_url"), F.col("dst_url")))
    frontier = seeds.select("url").distinct()
    if verdicts is not None:
        bad = verdicts.where("not allowed").select("url")
        links = links.join(bad.withColumnRenamed("url", "dst_url"), "dst_url", "left_anti")
        frontier = frontier.join(bad, "url", "left_anti")
    visited = None
    found = None
    depth, counted = 0, 0
    while counted < max_pages:
        frontier = _written(frontier)
        answered = frontier if pages is None else frontier.join(pages.select("url").distinct(), "url", "left_semi")
        level = _written(answered.orderBy("url").limit(max_pages - counted).withColumn("depth", F.lit(depth)))
        n = level.count()
        counted += n
        visited = frontier if visited is None else visited.union(frontier)
        found = level if found is None else found.union(level)
        if n == 0 or counted >= max_pages:
            break
        frontier, depth = next_frontier(links, level, visited), depth + 1
    return found if found is not None else seeds.select("url", F.lit(0).alias("depth")).limit(0)
