"""Main text of HTML pages: selector, markers, automatic, body fallback, in that order of precedence.

Automatic extraction is this engine's own rule: without comments, script, style, nav, footer, header, aside and form the
first <article>, else the first <main>, accepted if it holds more than 100 characters. Elements are found with regular
expressions, so that everything but general selectors and NFKC stays in generated code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import urls as U
from .css import BLOCK_TAGS, select_text

#: Elements that the body fallback, and besides them automatic extraction, leave out.
DROPPED = ["script", "style", "nav", "footer", "header"]
DROPPED_AUTO = [*DROPPED, "aside", "form"]
#: Named characters that are decoded natively, in this order.
ENTITIES = [("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
CLOSING = "|".join(t for t in BLOCK_TAGS if t not in ("br", "hr"))
AUTO_LEAST = 100


def without(html: Column, tags: list[str]) -> Column:
    return F.regexp_replace(html, rf"(?is)<({'|'.join(tags)})\b[^>]*>.*?</\1\s*>", "")


def text_with_breaks(html: Column) -> Column:
    """Text of HTML: a line break after each block, tags out, characters decoded."""
    out = F.regexp_replace(html, rf"(?i)</({CLOSING})\s*>|<(br|hr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def element(html: Column, tag: str) -> Column:
    """Inside of the first element of that name, empty if there is none."""
    return F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)


def automatic(html: Column) -> Column:
    """Raw text of the article or main element, empty if there is neither."""
    bare = without(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), DROPPED_AUTO)
    return text_with_breaks(F.coalesce(F.nullif(element(bare, "article"), F.lit("")), element(bare, "main")))


def body(html: Column) -> Column:
    """Raw text of the body without boilerplate elements; null if there is no body."""
    bare = without(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), DROPPED)
    return F.when(bare.rlike(r"(?i)<body\b"), text_with_breaks(F.regexp_extract(bare, r"(?is)<body\b[^>]*>(.*?)(</body\s*>|\z)", 1)))


def markers(html: Column, start: Column, end: Column) -> Column:
    """HTML between the first start marker and the next end marker, tags and all; empty if either is missing."""
    at = F.position(start, html)
    begin = at + F.length(start)
    stop = F.position(end, html, begin)
    return F.when((at > 0) & (stop > 0), F.substring(html, begin, stop - begin)).otherwise("")


@F.arrow_udf(T.StringType())
def _selected(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, selector in batches:
        yield pa.array((select_text(h, s) if h is not None and s else None for h, s in zip(html.to_pylist(), selector.to_pylist())), pa.string())


def css_text(html: Column, selector: Column) -> Column:
    """Text of the first element that a selector matches, null if there is none; the tree is built in Arrow batches."""
    return _selected(html, selector)


def with_raw_text(pages: DataFrame, selectors: bool = False) -> DataFrame:
    """pages (html, status_code, and selector, start_marker, end_marker if there) with raw_text, extraction_method, extraction_confident, error.

    A selector or pair of markers that finds nothing is a failure of its own and never falls through. Null html or
    status is fetch_failed. Set selectors where the table may hold selectors: only then rows pass through Python.
    """
    for c in ("selector", "start_marker", "end_marker"):
        if c not in pages.columns:
            pages = pages.withColumn(c, F.lit(None).cast("string"))
    if "status_code" not in pages.columns:
        pages = pages.withColumn("status_code", F.lit(200))
    html = F.col("html")
    has_selector = F.coalesce(F.col("selector"), F.lit("")) != ""
    has_markers = (F.coalesce(F.col("start_marker"), F.lit("")) != "") & (F.coalesce(F.col("end_marker"), F.lit("")) != "")
    found = pages.withColumns(
        {
            "_css": css_text(F.when(has_selector, html), F.col("selector")) if selectors else F.lit(None).cast("string"),
            "_cut": F.when(has_markers, markers(html, F.col("start_marker"), F.col("end_marker"))),
            "_auto": F.when(~has_selector & ~has_markers, automatic(html)),
            "_body": F.when(~has_selector & ~has_markers, body(html)),
        }
    )
    auto_ok = F.length(X.collapse(F.col("_auto"))) > AUTO_LEAST
    fetched = html.isNotNull() & F.col("status_code").isNotNull()
    selected = F.col("_css").isNotNull()
    method = (
        F.when(~fetched, "fetch_failed")
        .when(has_selector, F.when(selected, "selector").otherwise("selector_failed"))
        .when(has_markers, F.when(F.col("_cut") != "", "markers").otherwise("markers_failed"))
        .when(auto_ok, "auto")
        .when(F.col("_body").isNotNull(), "body_fallback")
        .otherwise("failed")
    )
    known = pages["error"] if "error" in pages.columns else F.lit(None).cast("string")
    error = (
        F.when(~fetched, known)
        .when(has_selector & ~selected, F.concat(F.lit("Selector '"), F.col("selector"), F.lit("' not found")))
        .when(~has_selector & has_markers & (F.col("_cut") == ""), "Markers not found in HTML")
        .when(method == "body_fallback", "Main content extraction uncertain: using body fallback")
        .when(method == "failed", "No extractable content found")
    )
    raw = F.when(method == "selector", F.col("_css")).when(method == "markers", F.col("_cut")).when(method == "auto", F.col("_auto")).when(method == "body_fallback", F.col("_body")).otherwise("")
    out = found.withColumns({"raw_text": raw, "extraction_method": method, "extraction_confident": method.isin("selector", "markers", "auto"), "error": error})
    return out.drop("_css", "_cut", "_auto", "_body")


def with_fingerprints(pages: DataFrame, normalise: bool = True) -> DataFrame:
    """pages (raw_text, extraction_method) with main_content, its length, hash, blocks and counts.

    Pages that failed keep the empty text, the empty hash and no blocks. `normalise` applies NFKC, in Arrow batches.
    """
    failed = F.col("extraction_method").isin("fetch_failed", "failed", "selector_failed", "markers_failed")
    raw = X.nfkc(F.col("raw_text")) if normalise else F.col("raw_text")
    out = pages.withColumn("raw_text", F.when(failed, "").otherwise(raw))
    out = out.withColumn("main_content", X.collapse(F.col("raw_text"))).withColumn("blocks", X.blocks(F.col("raw_text")))
    return out.withColumns(
        {
            "main_content_length": F.length("main_content"),
            "sha256": F.when(failed, "").otherwise(X.sha256(F.col("main_content"))),
            "block_count": F.size("blocks"),
            "word_count": X.word_count(F.col("main_content")),
            "has_cjk": X.has_cjk(F.col("main_content")),
        }
    )


def extract_pages(pages: DataFrame, selectors: bool = False, normalise: bool = True) -> DataFrame:
    return with_fingerprints(with_raw_text(pages, selectors), normalise)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src_url, link_no, href, dst_url for each anchor in document order; repeated links stay."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    found = pages.select(F.col(url).alias("src_url"), hrefs.alias("h"))
    joined = F.transform(F.transform("h", lambda h: U.join(F.col("src_url"), h)), lambda j: U.normalized(j))
    out = found.select("src_url", F.posexplode(F.arrays_zip(F.col("h"), joined.alias("d"))).alias("link_no", "x"))
    return out.select("src_url", "link_no", F.col("x")["h"].alias("href"), F.col("x")["d"].alias("dst_url"))
