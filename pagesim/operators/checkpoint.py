"""Resuming an audit: what is left to do, and a versioned snapshot in a folder."""

from __future__ import annotations

import hashlib
import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
REQUIRED = ("start_time", "total_pages", "config", "fetched_urls")
HINT = "run with --no-resume"


class CheckpointError(Exception):
    pass


def plan_union(first: DataFrame, then: DataFrame) -> DataFrame:
    """input_idx, url: the URLs of both in order, each at its first place."""
    both = first.select(F.lit(0).alias("part"), "input_idx", "url").unionByName(then.select(F.lit(1).alias("part"), "input_idx", "url"))
    once = both.groupBy("url").agg(F.min(F.struct("part", "input_idx")).alias("at"))
    return once.select("url", (F.row_number().over(Window.orderBy("at")) - 1).cast("bigint").alias("input_idx"))


def remaining(planned: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows of planned (input_idx, url) that were not fetched; repeated URLs stay; without a plan the fetched ones count."""
    return planned.join(fetched.select("url").distinct(), "url", "left_anti")


def with_inputs(urls: DataFrame, inputs: DataFrame) -> DataFrame:
    """urls with the selector and markers of the last saved input of each URL, null where there is none."""
    last = inputs.groupBy("url").agg(F.max_by(F.struct("selector", "start_marker", "end_marker"), "input_idx").alias("i"))
    return urls.join(last, "url", "left").select(*urls.columns, "i.selector", "i.start_marker", "i.end_marker")


def config_differences(saved: DataFrame, current: DataFrame) -> DataFrame:
    """key, saved, current of the settings (key, value) that differ, missing ones as null."""
    a, b = saved.select("key", F.col("value").alias("saved")), current.select("key", F.col("value").alias("current"))
    return a.join(b, "key", "full").where(~F.col("saved").eqNullSafe(F.col("current")))


def input_digest(planned_urls: list[str], planned_inputs: list[dict[str, Any]]) -> str:
    """SHA-256 of the plan as compact JSON with sorted keys, characters kept."""
    text = json.dumps({"planned_inputs": planned_inputs, "planned_urls": planned_urls}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


class FetchedUrls:
    """The URLs of a snapshot's pages; they stay in its table until they are asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __len__(self) -> int:
        return self.spark.read.parquet(self.path).count()

    def __iter__(self):
        return (r.url for r in self.spark.read.parquet(self.path).select("url").toLocalIterator())


class Checkpoint:
    """A snapshot of an audit in a folder that Spark can write to: pages as Parquet, and a manifest that names them.

    The manifest is written last, under a new number, so that a reader never sees half a snapshot.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, top = self._fs(), self._path("manifest")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(top)) if fs.exists(top) else []

    def exists(self) -> bool:
        return bool(self._numbers())

    def save(self, pages: DataFrame, config: dict[str, Any], planned_urls: list[str], planned_inputs: list[dict[str, Any]], start_url: str | None = None, start_time: float | None = None, crawl_mode: bool = False) -> None:
        """A snapshot anew; the URLs fetched are those of its pages."""
        number = max(self._numbers(), default=0) + 1
        pages.write.mode("overwrite").parquet(f"{self.folder}/pages/{number}")
        state = {"schema_version": SCHEMA_VERSION, "start_url": start_url, "start_time": start_time or time.time(), "total_pages": len(planned_urls), "config": config, "crawl_mode": crawl_mode, "input_digest": input_digest(planned_urls, planned_inputs), "planned_urls": planned_urls, "planned_inputs": planned_inputs, "pages": number}
        self.spark.createDataFrame([(json.dumps(state, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/{number}")
        for old in self._numbers()[:-1]:
            self._fs().delete(self._path(f"manifest/{old}"), True)
            self._fs().delete(self._path(f"pages/{old}"), True)

    def add(self, pages: DataFrame) -> None:
        """More pages for the newest snapshot; a write that breaks off leaves those before it as they were."""
        state = self.load()
        if state is None:
            raise CheckpointError(f"there is no state; {HINT}")
        pages.write.mode("append").parquet(f"{self.folder}/pages/{state['pages']}")

    def load(self) -> dict[str, Any] | None:
        """The manifest of the newest snapshot, null if there is none; a damaged or foreign one is an error."""
        numbers = self._numbers()
        if not numbers:
            return None
        try:
            state = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest/{numbers[-1]}").collect()))
        except ValueError as e:
            raise CheckpointError(f"the state cannot be read: {e}; {HINT}") from e
        if isinstance(state, dict) and "pages" in state and "fetched_urls" not in state:
            state["fetched_urls"] = FetchedUrls(self.spark, f"{self.folder}/pages/{state['pages']}")
        return validated(state)

    def pages(self) -> DataFrame:
        state = self.load()
        if state is None:
            raise CheckpointError(f"there is no state; {HINT}")
        return self.spark.read.parquet(f"{self.folder}/pages/{state['pages']}")

    def resume_info(self) -> dict[str, Any] | None:
        state = self.load()
        return state and {"start_url": state["start_url"], "elapsed_seconds": time.time() - state["start_time"], "total_pages": state["total_pages"], "fetched_pages": len(state["fetched_urls"]), "crawl_mode": state["crawl_mode"]}

    def clear(self) -> None:
        for name in ("manifest", "pages"):
            self._fs().delete(self._path(name), True)


def validated(state: Any) -> dict[str, Any]:
    if not isinstance(state, dict):
        raise CheckpointError(f"the state is not an object; {HINT}")
    if state.get("schema_version") != SCHEMA_VERSION:
        raise CheckpointError(f"the state has version {state.get('schema_version')}, not {SCHEMA_VERSION}; {HINT}")
    if missing := [k for k in REQUIRED if k not in state]:
        raise CheckpointError(f"the state lacks {', '.join(missing)}; {HINT}")
    if not isinstance(state["config"], dict) or not isinstance(state["fetched_urls"], list | FetchedUrls):
        raise CheckpointError(f"the state has fields of another kind; {HINT}")
    return state
