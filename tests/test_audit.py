"""Extraction, templates, robots files, crawling, snapshots, reports, the stream and the command line."""

import csv
import http.server
import io
import json
import threading

import pytest
from pyspark.sql import functions as F

from pagesim.operators import checkpoint, crawl, extract, report, robots, template
from pagesim.plans import audit
from pagesim.sources import inputs, webpages
from pagesim.streaming import incremental

LONG = "Words about a river that runs past the mill and the old stone bridge, then on to the sea without a pause. "


def page(main, title="t"):
    return f"<html><head><title>{title}</title></head><body><header>top</header><nav><a href='/x'>x</a></nav><main><article>{main}</article></main><footer>end</footer></body></html>"


def rows(spark, data, schema="input_idx bigint, url string, html string, status_code int, selector string, start_marker string, end_marker string"):
    return spark.createDataFrame(data, schema)


def test_precedence_of_extraction(spark):
    html = page(f"<p id=a>first</p><p>{LONG * 2}</p>")
    data = [(0, "u", html, 200, "#a", "<p", "</p>"), (1, "u", html, 200, "#none", "<article>", "</article>"), (2, "u", html, 200, None, "<article>", "</article>"), (3, "u", html, 200, None, "<article>", None), (4, "u", html, 200, None, "<none>", "</p>")]
    data += [(5, "u", "<body><nav>n</nav>short</body>", 404, "", "", ""), (6, "u", "no elements", 200, None, None, None), (7, "u", None, None, None, None, None), (8, "u", "<a></a>", 200, None, "<a>", "</a>")]
    got = {r.input_idx: r for r in extract.extract_pages(rows(spark, data), selectors=True).collect()}
    assert [got[k].extraction_method for k in range(9)] == ["selector", "selector_failed", "markers", "auto", "markers_failed", "body_fallback", "failed", "fetch_failed", "markers_failed"]
    assert got[0].main_content == "first" and got[1].error == "Selector '#none' not found" and "<p id=a>" in got[2].main_content
    assert got[5].main_content == "short" and not got[5].extraction_confident and got[6].sha256 == "" and got[7].blocks == []


def test_blocks_and_normal_forms(spark):
    html = page("".join(f"<p>Paragraph {k} {LONG}</p>" for k in range(12)))
    wide = page(f"<p>ＡＢＣ {LONG}</p>"), page(f"<p>ABC {LONG}</p>")
    got = {r.input_idx: r for r in extract.extract_pages(rows(spark, [(k, "u", h, 200, None, None, None) for k, h in enumerate([html, *wide])])).collect()}
    assert got[0].block_count == 12 and got[1].sha256 == got[2].sha256


def test_template_blocks(spark):
    def common(lists):
        pages = spark.createDataFrame([(k, b) for k, b in enumerate(lists)], "page_id bigint, blocks array<string>")
        return {r.block for r in template.common_blocks(pages).collect()}, template.template_enabled(pages)

    assert common([["a", "a"], ["a"], ["a"], ["a"]]) == (set(), False)
    assert common([["a", "b", "c"], ["a", "b"], ["a", "b"], ["a"], ["a", "d"]]) == ({"a", "b"}, True)
    own = spark.createDataFrame([(0, ["a", "x", "a", "x"])], "page_id bigint, blocks array<string>")
    assert template.with_clean_blocks(own, spark.createDataFrame([("a", 3)], "block string, df bigint")).first().clean_blocks == ["x", "x"]


@pytest.mark.parametrize(
    "text, url, allowed",
    [
        ("User-agent: *\nDisallow: /p", "http://h/p/x", False),
        ("User-agent: *\nDisallow: /p\nAllow: /p/x", "http://h/p/x", True),
        ("User-agent: *\nDisallow: /p\nAllow: /p", "http://h/p", True),
        ("User-agent: *\nDisallow: /*.php$", "http://h/a.php", False),
        ("User-agent: *\nDisallow: /*.php$", "http://h/a.php?x", True),
        ("User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow:", "http://h/a", False),
        ("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow:", "http://h/a", True),
        ("User-agent: a\nUser-agent: bot\nDisallow: /x", "http://h/x", False),
        ("Disallow: /\nUser-agent: *\nAllow: /", "http://h/x", True),
        ("User-agent: *\nDisallow: /q?a=", "http://h/q?a=1", False),
        ("User-agent: *\nDisallow: /a.b", "http://h/axb", True),
        ("User-agent: *\nCrawl-delay: 1\nUser-agent: bot\nDisallow: /x", "http://h/x", False),
        ("User-agent: *\nSitemap: http://h/s\nDisallow: /x", "http://h/x", False),
        ("", "http://h/x", True),
    ],
)
def test_robots_verdicts(spark, text, url, allowed):
    rules = robots.parse_robots(spark.createDataFrame([("h", text)], "host string, body string"))
    assert robots.robots_verdict(spark.createDataFrame([(url,)], "url string"), rules, "bot").first().allowed is allowed


def test_crawl_stops_at_the_cap_and_at_closed_doors(spark):
    edges = spark.createDataFrame([(f"http://h/{k}", f"http://h/{k + 1}") for k in range(9)] + [("http://h/1", "http://o/1"), ("http://h/2", "http://h/x.pdf")], "src_url string, dst_url string")
    seeds = spark.createDataFrame([("http://h/0",)], "url string")
    assert {r.url: r.depth for r in crawl.crawl(edges, seeds, 4).collect()} == {f"http://h/{k}": k for k in range(4)}
    shut = spark.createDataFrame([("http://h/2", False)], "url string, allowed boolean")
    assert crawl.crawl(edges, seeds, 50, verdicts=shut).count() == 2
    assert crawl.crawl(edges, seeds, 50, verdicts=spark.createDataFrame([("http://h/0", False)], "url string, allowed boolean")).count() == 0
    assert "http://o/1" in {r.url for r in crawl.crawl(edges, seeds, 50, follow_external=True).collect()}


def test_snapshot_round_trip(spark, tmp_path):
    c = checkpoint.Checkpoint(spark, f"{tmp_path}/state")
    assert not c.exists() and c.load() is None
    pages = spark.createDataFrame([(0, "u0", "h"), (1, "u1", None)], "input_idx bigint, url string, html string")
    for _ in range(2):
        c.save(pages, {"timeout": "10"}, ["u0", "u1", "u2"], [{"input_idx": k, "url": f"u{k}"} for k in range(3)])
    state = c.load()
    assert sorted(state["fetched_urls"]) == ["u0", "u1"] and len(state["fetched_urls"]) == 2 and state["input_digest"] == checkpoint.input_digest(state["planned_urls"], state["planned_inputs"])
    assert c.pages().count() == 2 and c.resume_info()["fetched_pages"] == 2
    left = checkpoint.remaining(inputs.url_list(spark, state["planned_urls"]), c.pages())
    assert [r.url for r in left.collect()] == ["u2"]
    c.clear()
    assert not c.exists()
    for bad in ([], {"schema_version": 1}, {"schema_version": 2}):
        with pytest.raises(checkpoint.CheckpointError, match="no-resume"):
            checkpoint.validated(bad)


def test_plans_from_lists_and_csv(spark, tmp_path):
    path = tmp_path / "plan.csv"
    path.write_text('url,selector,extra\nhttp://a/1,#x,9\n"http://a/2",,\n', encoding="utf-8")
    got = inputs.load_plan(spark, [str(path)]).orderBy("input_idx").collect()
    assert [(r.url, r.selector, r.start_marker) for r in got] == [("http://a/1", "#x", None), ("http://a/2", None, None)]
    with pytest.raises(inputs.InputError, match="at least 2"):
        inputs.check_plan(inputs.load_plan(spark, ["http://a/1"]))
    with pytest.raises(inputs.InputError, match="Invalid URL 'ftp://b'"):
        inputs.check_plan(inputs.load_plan(spark, ["http://a/1", "ftp://b"]))
    with pytest.raises(inputs.InputError):
        inputs.check_plan(inputs.url_list(spark, [f"http://a/{k}" for k in range(201)]))


def test_reports(spark, tmp_path):
    data = [(k, f"http://h/{k}|", page(f"<p>{LONG * 2}</p>" if k < 3 else f"<p>Other text number {k} {'xyz ' * 40}</p>"), 200, None, None, None) for k in range(6)]
    code, pages, pairs = audit.audit_pages(rows(spark, data), f"{tmp_path}/out")
    assert code == 0 and pairs.count() == 15
    own = json.loads((tmp_path / "out/pages.json").read_text())
    assert own["summary"] == {"total": 6, "successful": 6, "uncertain": 0, "failed": 0} and len(own["pages"]) == 6
    table = list(csv.DictReader(io.StringIO((tmp_path / "out/pairs.csv").read_text())))
    assert sum(r["priority"] == "P1" and r["sha256_match"] == "True" for r in table) >= 3 and list(table[0])[0] == "url1"
    text = (tmp_path / "out/report.md").read_text()
    assert "* Pages: 6\n" in text and "http://h/0\\|" in text and "(P1)" in text and "comparison: " in text
    again, both = report.read_reports(spark, f"{tmp_path}/out")
    assert again.count() == 6 and both.count() == 15 and both.where("priority = 'P1' and sha256_match and size(trigger_reasons) > 0").count() == pairs.where("priority = 'P1' and sha256_match").count()
    assert both.agg(F.max("jaccard_3gram")).first()[0] == 1.0
    assert report.rounded(3 / 160) == 0.0187 and report.rounded(0.0) == 0.0 and report.rounded(None) is None


def test_gates_end_an_audit(spark):
    data = [(k, f"u{k}", None if k < 2 else page(LONG * 2), None if k < 2 else 200, None, None, None) for k in range(5)]
    code, _, pairs = audit.audit_pages(rows(spark, data))
    assert code == audit.FETCH_FAILED and pairs.count() == 0
    code, _, _ = audit.audit_pages(rows(spark, [(k, "u", "x" if k < 2 else page(LONG * 2), 200, None, None, None) for k in range(5)]))
    assert code == audit.EXTRACTION_FAILED


class _Site(http.server.BaseHTTPRequestHandler):
    robots = "User-agent: *\nDisallow: /p3\n"

    def do_GET(self):
        kind, status, body = "text/html; charset=utf-8", 200, None
        if self.path == "/robots.txt":
            kind, body = "text/plain", self.robots
        elif self.path == "/":
            body = page(LONG * 2 + "".join(f"<a href='/p{k}'>p</a>" for k in range(5)))
        elif self.path == "/pdf":
            kind, body = "application/pdf", "x"
        elif self.path.startswith("/p"):
            body = page(f"<p>{LONG * 2}</p><p>{self.path}</p><a href='/'>home</a>")
        elif self.path == "/big":
            body = "x" * 50_000
        elif self.path == "/loop":
            status, body = 302, ""
        else:
            status, body = 404, page("gone")
        raw = body.encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(raw)))
        if status == 302:
            self.send_header("Location", "/loop")
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(site):
    s = webpages.Settings(allow_private=True, max_response_size=20_000, max_retries=0)
    assert webpages.fetch(f"{site}/p1", s)[1:] == (200, None) and webpages.fetch(f"{site}/none", s)[1] == 404
    assert webpages.fetch(f"{site}/big", s)[2].startswith("Response too large") and webpages.fetch(f"{site}/pdf", s)[2] == "Unsupported content type: application/pdf"
    assert "redirects" in webpages.fetch(f"{site}/loop", s)[2]
    assert "non-public" in webpages.fetch(f"{site}/p1", webpages.Settings())[2]
    assert webpages.fetch("ftp://x", s)[2].startswith("only http")
    with pytest.raises(ValueError):
        webpages.Settings(timeout=0)


def test_bodies_stop_at_the_limit():
    import gzip
    import zlib

    packed = gzip.compress(b"a" * 100_000)
    assert webpages.decoded(iter([packed]), "gzip", 200_000) == b"a" * 100_000
    assert webpages.decoded(iter([zlib.compress(b"abc")]), "deflate", 10) == b"abc"
    with pytest.raises(webpages.Rejected, match="exceeded 5000"):
        webpages.decoded(iter([packed]), "gzip", 5000)


def test_command_line_crawl_and_list(spark, site, tmp_path):
    out = str(tmp_path / "crawl")
    assert audit.run(spark, ["--crawl", f"{site}/", "--allow-private", "--rate-limit", "100", "--output-dir", out]) == audit.OK
    urls = {p["url"] for p in json.loads((tmp_path / "crawl/pages.json").read_text())["pages"]}
    assert urls == {f"{site}/", *(f"{site}/p{k}" for k in (0, 1, 2, 4))}
    assert audit.run(spark, [f"{site}/p1", f"{site}/p2", "--allow-private", "--rate-limit", "100", "--output-dir", str(tmp_path / "list")]) == audit.OK
    assert audit.run(spark, [f"{site}/p1"]) == audit.BAD_INPUT and audit.run(spark, ["a", "b", "--timeout", "0"]) == audit.BAD_INPUT
    assert audit.run(spark, [f"{site}/none1", f"{site}/none2", "--allow-private", "--rate-limit", "100", "--output-dir", str(tmp_path / "gone")]) == audit.FETCH_FAILED


def test_fetching_saves_as_it_goes(spark, site, tmp_path, monkeypatch):
    out, fetched, real = str(tmp_path / "broken"), [], audit.Pace.fetched

    def breaks(self, plan, options):
        if len(fetched) == 2:
            raise KeyboardInterrupt
        fetched.append(real(self, plan, options).count())
        return real(self, plan, options)

    monkeypatch.setattr(audit, "SAVED", 1)
    monkeypatch.setattr(audit.Pace, "fetched", breaks)
    argv = [*(f"{site}/p{k}" for k in range(1, 6)), "--allow-private", "--rate-limit", "100", "--max-concurrent", "2", "--output-dir", out]
    assert audit.run(spark, argv) == audit.FATAL
    kept = checkpoint.Checkpoint(spark, f"{out}/.state")
    assert kept.pages().count() == 4 and kept.resume_info()["fetched_pages"] == 4
    monkeypatch.setattr(audit.Pace, "fetched", real)
    assert audit.run(spark, [*argv, "--resume"]) == audit.OK and not kept.exists()
    assert len(json.loads((tmp_path / "broken/pages.json").read_text())["pages"]) == 5


def test_pace_holds_within_and_across_reads(site, monkeypatch):
    host = site.split("//")[1]
    asked = []
    monkeypatch.setattr(webpages, "fetch", lambda u, s: (asked.append((u, webpages.time.time())), ("", 200, None))[1])
    settings = webpages.Settings(rate_limit=50, max_concurrent=2)
    urls = [f"{site}/{k}" for k in range(4)] + ["http://b.example/1", "http://c.example/1", "http://d.example/1"]
    reader = webpages._Reader(urls, settings, {host: 0.15}, {"b.example": webpages.time.time() + 0.2})
    parts = reader.partitions()
    assert len(parts) == 2 and sorted(k for p in parts for own in p.hosts for k, _ in own) == list(range(7))
    began = webpages.time.time()
    got = [row for p in parts for row in reader.read(p)]
    at = {u: t for u, t in asked}
    assert len(got) == 7 and all(at[f"{site}/{k + 1}"] - at[f"{site}/{k}"] >= 0.149 for k in range(3)) and at["http://b.example/1"] - began >= 0.2


def test_crawl_obeys_the_delay_of_robots_files(spark, site, monkeypatch):
    told, real = [], audit.fetch_plan
    monkeypatch.setattr(audit, "fetch_plan", lambda plan, options: (told.append(options), real(plan, options))[1])
    monkeypatch.setattr(_Site, "robots", "User-agent: *\nCrawl-delay: 0.2\nDisallow: /p3\n")
    pages, warnings = audit.crawl_site(spark, f"{site}/", 3, {"allow_private": "true", "rate_limit": "100"})
    host = site.split("//")[1]
    assert pages.count() == 3 and not warnings and told[0]["last"] == "" and all(f"{host} 0.2" in o["intervals"] and host in o["last"] for o in told[1:])


def test_verdicts_keep_repeated_urls(spark):
    rules = robots.parse_robots(spark.createDataFrame([("h", "User-agent: *\nDisallow: /a")], "host string, body string"))
    got = robots.robots_verdict(spark.createDataFrame([("http://h/a",), ("http://h/a",), ("http://h/b",)], "url string"), rules).collect()
    assert sorted((r.url, r.allowed) for r in got) == [("http://h/a", False), ("http://h/a", False), ("http://h/b", True)]


def test_streamed_duplicates(spark, tmp_path):
    src = str(tmp_path / "in")
    incremental_pages = [(0, "u0", page(LONG * 2)), (1, "u1", page(LONG * 2)), (2, "u2", page(LONG * 3))]
    spark.createDataFrame(incremental_pages, incremental.PAGE_ROWS).coalesce(1).write.parquet(src)
    go = lambda: incremental.duplicate_alerts(incremental.extracted(incremental.read_pages(spark, src, 1)), str(tmp_path / "history"), str(tmp_path / "alerts"), str(tmp_path / "ck")).awaitTermination()
    go()
    spark.createDataFrame([(7, "u7", page(LONG * 3))], incremental.PAGE_ROWS).coalesce(1).write.mode("append").parquet(src)
    go()
    assert {(r.page_id, r.first_id) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()} == {(1, 0), (7, 2)}


def test_windowed_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = incremental.counts_by_window(events)
    assert got.agg(F.sum("n")).first()[0] == events.count()
