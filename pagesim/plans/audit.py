"""The whole audit: plan, fetch, extract, template, pairs, reports; and its command line."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import checkpoint, classify, crawl, extract, pairs, report, robots, template
from ..schemas import PAIR_REPORT
from ..sources import inputs, webpages

VERSION = "0.1.0"
OK, BAD_INPUT, FETCH_FAILED, EXTRACTION_FAILED, FATAL = range(5)
MOST_CRAWLED = 1000
#: Pages between two times that what was fetched is saved.
SAVED = 10


def score(pages: DataFrame, min_pages: int = 5, percent: int = 60) -> tuple[DataFrame, int | None]:
    """(classified pairs, common blocks or null if there are too few pages) of extracted pages with input_idx."""
    n_common, common, own = None, None, pages
    if template.template_enabled(pages, min_pages):
        common = template.common_blocks(pages, min_pages, percent)
        n_common = common.count()
        own = template.with_clean_blocks(pages, common)
    return classify.classified(pairs.score_pairs(own, common, key="input_idx")), n_common


def audit_pages(fetched: DataFrame, folder: str | None = None, times: dict[str, float] | None = None) -> tuple[int, DataFrame, DataFrame]:
    """(exit code, pages, pairs) for fetched pages (input_idx, url, html, status_code, error, optional selector and markers).

    Too many failed fetches or extractions end the audit with reports of the pages and no pairs. times: seconds by name of
    what went before, for the report.
    """
    times, began = dict(times or {}), time.time()
    pages = extract.extract_pages(fetched, selectors="selector" in fetched.columns).drop("html", "raw_text").persist()
    code = report.failure_gates(pages).first().exit_code
    times["extraction"] = time.time() - began
    if code:
        found, n_common = pages.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in PAIR_REPORT if c != "trigger_reasons") + ", trigger_reasons array<string>, k1 bigint, k2 bigint"), None
    else:
        began = time.time()
        found, n_common = score(pages)
        found = found.persist()
        found.count()
        times["comparison"] = time.time() - began
    if folder:
        report.write_reports(pages, found, n_common, folder, times | {"all": sum(times.values())})
    return code, pages, found


def fetch_plan(plan: DataFrame, options: dict[str, str]) -> DataFrame:
    """The plan's pages: each host's URLs by one task. Only the URL list, capped by the caller, comes to the driver."""
    spark = plan.sparkSession
    spark.dataSource.register(webpages.WebPages)
    rows = plan.orderBy("input_idx").select("input_idx", "url").collect()
    numbers = spark.createDataFrame([(k, r.input_idx) for k, r in enumerate(rows)], "_k bigint, input_idx bigint")
    got = spark.read.format("webpages").options(urls="\n".join(r.url for r in rows), **options).load().withColumnRenamed("input_idx", "_k")
    return got.join(numbers, "_k").drop("_k").join(plan.drop("url"), "input_idx")


class Pace:
    """When each host was asked last, and how long it wants to be left alone: what one read of pages tells the next."""

    def __init__(self):
        self.last: dict[str, float] = {}
        self.intervals: dict[str, float] = {}

    def fetched(self, plan: DataFrame, options: dict[str, str]) -> DataFrame:
        """The plan's pages, fetched now and kept."""
        told = {name: "\n".join(f"{host} {x!r}" for host, x in own.items()) for name, own in (("intervals", self.intervals), ("last", self.last))}
        got = fetch_plan(plan, options | told).persist()
        hosts = {r.h for r in got.select(F.lower(U.netloc(F.col("url"))).alias("h")).distinct().collect()}
        self.last.update(dict.fromkeys(hosts, time.time()))
        return got


def fetch_and_save(plan: DataFrame, options: dict[str, str], kept: checkpoint.Checkpoint) -> None:
    """Fetch the plan's pages and add them to the snapshot, SAVED of each task's hosts at a time, so that little is lost."""
    pace = Pace()
    left = plan.orderBy("input_idx").persist()
    at_once = SAVED * max(1, int(options.get("max_concurrent", 4)))
    numbered = [r.input_idx for r in left.select("input_idx").collect()]
    for k in range(0, len(numbered), at_once):
        some = pace.fetched(left.where(F.col("input_idx").isin(numbered[k : k + at_once])), options)
        kept.add(some)
        some.unpersist()


def crawl_site(spark: SparkSession, start: str, max_pages: int, options: dict[str, str], respect_robots: bool = True, follow_external: bool = False, agent: str = "pagesim") -> tuple[DataFrame, list[str]]:
    """(input_idx, url, html, status_code, error of the pages found, robots warnings), a level at a time, each page fetched once.

    A host's Crawl-delay is its least pause, from its robots file on and from one level to the next. A level's links are
    taken in order of their URLs, as many as pages are still wanted.
    """
    first = inputs.url_list(spark, [start]).select(U.normalized(F.col("url")).alias("url"))
    frontier = [r.url for r in first.collect()]
    seen, warnings, found, allowed_hosts = set(frontier), [], None, {}
    rules, pace = None, Pace()
    n = 0
    while frontier and n < max_pages:
        level = inputs.url_list(spark, frontier[: max_pages - n])
        if respect_robots:
            hosts = {r.h for r in level.select(U.netloc(F.col("url")).alias("h")).distinct().collect()} - set(allowed_hosts)
            if hosts:
                files = [f"{'https' if frontier[0].startswith('https') else 'http'}://{h}/robots.txt" for h in sorted(hosts)]
                got = pace.fetched(inputs.url_list(spark, files), options | {"require_html": "false", "follow_redirects": "false"})
                got = got.select(U.netloc(F.col("url")).alias("host"), F.col("status_code").alias("status"), F.coalesce("html", F.lit("")).alias("body")).persist()
                for r in robots.availability(got).collect():
                    allowed_hosts[r.host] = not r.denied
                    warnings += [r.warning] if r.denied else []
                answered = got.where("status = 200").select("host", "body")
                for r in robots.delay_policy(robots.crawl_delays(answered), float(options.get("rate_limit", 2))).collect():
                    pace.intervals[r.host.lower()] = r.min_interval
                    warnings += [f"Crawl-delay {r.crawl_delay:g} of {r.host} is taken as {r.used_delay or 0:g}"] if r.warned else []
                own = robots.parse_robots(answered)
                rules = own if rules is None else rules.union(own)
            good = [h for h, ok in allowed_hosts.items() if ok]
            level = level.where(U.netloc(F.col("url")).isin(good))
            if rules is not None:
                level = robots.robots_verdict(level, rules, agent).where("allowed").select("input_idx", "url")
        pages = pace.fetched(level.select("input_idx", "url"), options)
        ok = pages.where("status_code = 200 and html is not null")
        n += ok.count()
        found = ok if found is None else found.union(ok)
        links = extract.links(ok)
        keep = U.problem(F.col("dst_url")).isNull() & U.crawlable_ending(F.col("dst_url"))
        links = links.where(keep if follow_external else keep & U.same_site(F.col("src_url"), F.col("dst_url")))
        known = spark.createDataFrame([(u,) for u in seen], "dst_url string")  # at most a level's worth of URLs a level
        fresh = links.select("dst_url").distinct().join(known, "dst_url", "left_anti").orderBy("dst_url").limit(max(0, max_pages - n) * 2 + SAVED)
        frontier = [r.dst_url for r in fresh.collect()]
        seen.update(frontier)
    if found is None:
        found = fetch_plan(inputs.url_list(spark, []), options)
    return found.withColumn("input_idx", F.monotonically_increasing_id()), warnings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagesim", description="Find exact and near-duplicate pages.")
    p.add_argument("input", nargs="*", help="URLs, or one CSV file with a url column")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--output-dir", "--output", default="audit-output")
    p.add_argument("--crawl", metavar="URL")
    p.add_argument("--max-pages", type=int, default=200)
    p.add_argument("--follow-external", action="store_true")
    p.add_argument("--ignore-robots", action="store_true")
    p.add_argument("--max-response-size", type=int, default=2 << 20)
    p.add_argument("--timeout", type=float, default=10)
    p.add_argument("--rate-limit", "--per-host-rate", type=float, default=2)
    p.add_argument("--max-concurrent", "--concurrency", type=int, default=4)
    p.add_argument("--allow-private", action="store_true")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--no-resume", action="store_true")
    return p


def check_options(a: argparse.Namespace) -> None:
    for name in ("max_pages", "max_response_size", "timeout", "rate_limit", "max_concurrent"):
        if getattr(a, name) <= 0:
            raise inputs.InputError(f"--{name.replace('_', '-')} must be positive")
    if a.max_pages > MOST_CRAWLED:
        raise inputs.InputError(f"--max-pages must be at most {MOST_CRAWLED}")


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    try:
        check_options(a)
        options = {"timeout": str(a.timeout), "rate_limit": str(a.rate_limit), "max_response_size": str(a.max_response_size), "allow_private": str(a.allow_private).lower(), "max_concurrent": str(a.max_concurrent)}
        config = options | {"max_pages": str(a.max_pages), "crawl_mode": str(bool(a.crawl)).lower()}
        kept = checkpoint.Checkpoint(spark, f"{a.output_dir}/.state")
        state = kept.load() if a.resume and not a.no_resume else None
        started = state["start_time"] if state else time.time()
        if state:
            planned = inputs.url_list(spark, state["planned_urls"])
            for r in checkpoint.config_differences(*(spark.createDataFrame([(k, v) for k, v in c.items()], "key string, value string") for c in (state["config"], config))).collect():
                print(f"warning: {r.key}: saved={r.saved}, current={r.current}")
            plan = inputs.with_nulls(spark.createDataFrame(state["planned_inputs"], "input_idx bigint, url string, selector string, start_marker string, end_marker string")) if state["planned_inputs"] else planned
            left = checkpoint.remaining(plan, kept.pages())
            print(f"resuming: {len(state['fetched_urls'])} of {state['total_pages']} pages are fetched")
            fetch_and_save(left, options, kept)
        elif a.crawl:
            fetched, warnings = crawl_site(spark, a.crawl, a.max_pages, options, not a.ignore_robots, a.follow_external)
            for w in warnings:
                print(f"warning: {w}")
            inputs.check_plan(fetched.select("input_idx", "url"), None)
            rows = fetched.select("input_idx", "url").orderBy("input_idx").collect()
            kept.save(fetched, config, [r.url for r in rows], [r.asDict() for r in rows], a.crawl, started, True)
        else:
            plan = inputs.load_plan(spark, a.input)
            inputs.check_plan(plan)
            rows = plan.orderBy("input_idx").collect()
            kept.save(fetch_plan(plan.limit(0), options), config, [r.url for r in rows], [r.asDict() for r in rows], None, started, False)
            fetch_and_save(plan, options, kept)
        fetched = kept.pages().persist()
        print(f"{fetched.count()} pages fetched")
        code, pages, found = audit_pages(fetched, a.output_dir, {"fetching": time.time() - started})
        if not code:
            kept.clear()
            c = report.priority_counts(found).first()
            print(f"{pages.count()} pages, {c.total_pairs} pairs: P1 {c.p1}, P2 {c.p2}, P3 {c.p3}")
        return code
    except (inputs.InputError, checkpoint.CheckpointError) as e:
        print(f"error: {e}", file=sys.stderr)
        return BAD_INPUT
    except KeyboardInterrupt:
        return FATAL


def main() -> None:
    spark = SparkSession.builder.appName("pagesim").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
