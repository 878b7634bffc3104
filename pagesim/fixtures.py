"""Small literal tables for queries on what the corpus tables lack: link graphs, robots files, addresses, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "edges": (
        "src_url string, dst_url string",
        [(f"https://shop.example/p{i}", f"https://shop.example/p{j}") for i in range(12) for j in ((i * 3 + 1) % 15, (i + 1) % 12, i)]
        + [("https://shop.example/p1", "https://other.example/x"), ("https://shop.example/p2", "https://shop.example/a.pdf"), ("https://shop.example/p3", "https://shop.example/q?x=1"), ("https://shop.example/q?x=1", "https://shop.example/deep"), ("https://other.example/x", "https://other.example/y")],
    ),
    "csv_rows": ("input_idx bigint, url string, selector string, start_marker string, end_marker string", [(0, "https://a.example/1", "", "", ""), (1, "https://a.example/2", "#main", "", ""), (2, "https://a.example/1", "", "<!--s-->", "<!--e-->"), (3, "https://b.example/é?x=ü", ".c", "a", "")]),
    "odd_urls": (
        "url string",
        [(u,) for u in ["https://h", "https://h/", "https://h/a/", "http://h/a;p=1?q=a/", "HTTPS://H.example/A/#f", "ftp://h/x", "https://", "https://user:pw@h/x", "https://h:99999/", "https://h:8080/x/", "mailto:a@b", "", "https://h/a/b;x/", "https://h//", "https://h/?", "http://h/img.PNG", "http://h/doc.pdf?x=1", "https://h/tag/x", "https://h/x?page=2"]],
    ),
    "robots_files": (
        "host string, body string",
        [
            ("a.example", "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2\nSitemap: https://a.example/s.xml\n"),
            ("b.example", "# note\nUser-agent: auditbot\nUser-agent: other\nDisallow: /*.php$\n\nUser-agent: *\nDisallow: /\n"),
            ("c.example", "Disallow: /early\nUser-agent: *\nDisallow:\nCrawl-delay: x\nUser-agent: auditbot-news\nDisallow: /a*b\nAllow: /axb/c\nCrawl-delay: -1\n"),
            ("d.example", "user-agent: AUDITBOT # same\r\nDisallow: /q?x=\r\nSitemap: https://d.example/1.xml\r\nDisallow: /w\r\nUser-agent:\r\nDisallow: /lost\r\nCrawl-delay: 999999\r\n"),
            ("e.example", "no colon here\nUnknown: x\n"),
        ],
    ),
    "robots_urls": ("url string", [(f"https://{h}.example{p}",) for h in "abcdef" for p in ("", "/", "/private", "/private/open/x", "/x.php", "/x.php?y=1", "/early", "/axxb", "/axb/c", "/q?x=1", "/q", "/w", "/lost", "/wide/private")]),
    "robots_status": ("host string, status int", [("a.example", 200), ("b.example", 404), ("c.example", 429), ("d.example", 500), ("e.example", None), ("f.example", 302), ("g.example", 403)]),
    "addresses": ("ip string", [(x,) for x in ["8.8.8.8", "10.1.2.3", "100.64.0.1", "100.128.0.1", "127.0.0.1", "169.254.169.254", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.0.0.8", "192.0.2.1", "192.168.1.1", "198.17.255.255", "198.19.0.1", "198.51.100.7", "203.0.113.9", "224.0.0.1", "255.255.255.255", "1.1.1.1", "256.1.1.1", "1.2.3", "x"]]),
    "responses": ("url string, content_type string, content_encoding string", [("u1", "text/html; charset=utf-8", ""), ("u2", "application/xhtml+xml", "gzip"), ("u3", "application/pdf", "br"), ("u4", None, None), ("u5", "TEXT/HTML", "deflate"), ("u6", " image/png ;x", "identity")]),
    "planned": ("input_idx bigint, url string", [(i, f"https://a.example/{i % 9}") for i in range(12)]),
    "fetched": ("input_idx bigint, url string", [(i, f"https://a.example/{i}") for i in (1, 4, 7, 20)]),
    "saved_config": ("key string, value string", [("timeout", "10"), ("rate_limit", "2"), ("max_pages", "200"), ("crawl_mode", "false"), ("old", "1"), ("none", None)]),
    "current_config": ("key string, value string", [("timeout", "5"), ("rate_limit", "2"), ("max_pages", None), ("crawl_mode", "false"), ("new", "x"), ("none", None)]),
    "markdown": ("text string", [("a|b",), ("back\\slash",), ("two\nlines",), ("\\|\n",), ("plain",)]),
    "status_pages": ("url string, status_code int, extraction_method string, extraction_confident boolean", [(f"u{i}", (None if i % 11 == 0 else 404 if i % 7 == 0 else 200), ["auto", "selector", "body_fallback", "failed", "markers_failed", "fetch_failed", "markers"][i % 7], i % 7 in (0, 1, 6)) for i in range(40)]),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def values_sql(name: str) -> str:
    """The table as an SQL expression."""
    schema, rows = TABLES[name]
    columns = [c.strip().split(" ") for c in schema.split(",")]
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}

    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return " || ".join(f"chr({part})" if isinstance(part, int) else "'" + part.replace("'", "''") + "'" for part in _parts(x)) or "''"
        return str(x).upper() if isinstance(x, bool) else str(x)

    body = ", ".join("(" + ", ".join(f"({literal(x)})::{kinds[k]}" for x, (_, k) in zip(r, columns)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(c for c, _ in columns)}))"


def _parts(x: str) -> list:
    """The text with each control character as its number."""
    out: list = [""]
    for c in x:
        if ord(c) < 32:
            out += [ord(c), ""]
        else:
            out[-1] += c
    return [p for p in out if p != ""]
