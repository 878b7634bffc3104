"""Named queries over the tables of a folder; `oracle.py` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import policy
from .functions import text as X
from .functions import urls as U
from .operators import checkpoint, classify, crawl, extract, pairs, report, robots, template
from .sources import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AGENT = "AuditBot/1.0"
#: Blocks on this share of the pages count as template in the clean-view queries; the audit's own share is 60.
CLEAN_PERCENT = 2


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.page_table(spark, f"{sf_dir}/pages.parquet")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(pages(spark, sf_dir)).drop("html", "raw_text")


def cleaned(spark: SparkSession, sf_dir: str, percent: int) -> tuple[DataFrame, DataFrame]:
    own = extracted(spark, sf_dir)
    common = template.common_blocks(own, percent=percent)
    return template.with_clean_blocks(own, common), common


def scored(spark: SparkSession, sf_dir: str, urls: bool = True) -> DataFrame:
    """All pairs with the raw measures; the clean ones, of which none of its queries tells, are in clean_view_pairs."""
    return pairs.score_pairs(extracted(spark, sf_dir), urls=urls)


@query
def page_scan(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"))


@query
def csv_inputs(spark, sf_dir):
    return inputs.with_nulls(fixtures.table(spark, "csv_rows"))


@query
def url_parts(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.scheme(u).alias("scheme"), U.netloc(u).alias("netloc"), U.path(u).alias("path"), U.query(u).alias("query"), U.first_segment(u).alias("segment"))


def _urls(spark, sf_dir):
    return pages(spark, sf_dir).select("url").union(fixtures.table(spark, "odd_urls"))


@query
def url_normalized(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", U.normalized(F.col("url")).alias("normalized"))


@query
def url_validity(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", U.problem(F.col("url")).alias("problem"))


@query
def url_filters(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", U.crawlable_ending(F.col("url")).alias("crawlable"), U.excluded(F.col("url")).alias("excluded"), F.contains(F.lower("url"), F.lit("/product")).alias("is_product"))


@query
def link_extract(spark, sf_dir):
    return extract.links(pages(spark, sf_dir)).select("src_url", F.col("link_no").cast("bigint").alias("link_no"), "href", "dst_url")


@query
def same_domain_links(spark, sf_dir):
    own = extract.links(pages(spark, sf_dir))
    ok = U.problem(F.col("dst_url")).isNull() & U.crawlable_ending(F.col("dst_url")) & U.same_site(F.col("src_url"), F.col("dst_url"))
    return own.where(ok).select("src_url", F.col("link_no").cast("bigint").alias("link_no"), "dst_url")


@query
def link_out_degree(spark, sf_dir):
    return extract.links(pages(spark, sf_dir)).groupBy("src_url").agg(F.count("*").alias("links"), F.countDistinct("dst_url").alias("targets"))


@query
def host_page_counts(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(U.netloc(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query
def path_histogram_top10(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(U.first_segment(F.col("url")).alias("segment")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "segment").limit(10)


@query
def crawl_bfs(spark, sf_dir):
    return crawl.crawl(fixtures.table(spark, "edges"), spark.createDataFrame([("https://shop.example/p0",)], "url string"), max_pages=1000)


@query
def crawl_frontier_antijoin(spark, sf_dir):
    edges = fixtures.table(spark, "edges")
    visited = edges.where("src_url < 'https://shop.example/p3'").select(F.col("src_url").alias("url")).distinct()
    return crawl.next_frontier(edges, visited, visited)


@query
def extract_markers(spark, sf_dir):
    found = pages(spark, sf_dir).select("page_id", extract.markers(F.col("html"), F.lit("<article>"), F.lit("</article>")).alias("slice"))
    return found.select("page_id", F.length("slice").cast("bigint").alias("chars"), F.sha2("slice", 256).alias("slice_sha256"))


@query
def extract_article(spark, sf_dir):
    found = pages(spark, sf_dir).select("page_id", extract.automatic(F.col("html")).alias("raw"))
    return found.select("page_id", X.collapse(F.col("raw")).alias("content"))


@query
def extract_body_fallback(spark, sf_dir):
    found = pages(spark, sf_dir).select("page_id", extract.body(F.col("html")).alias("raw"))
    return found.select("page_id", F.sha2(X.collapse(F.col("raw")), 256).alias("body_sha256"), F.length(X.collapse(F.col("raw"))).cast("bigint").alias("chars"))


def _mixed(spark, sf_dir):
    """Pages with markers for some, ones that are missing for others, and broken HTML."""
    k = F.col("page_id") % 6
    return pages(spark, sf_dir).withColumns(
        {
            "start_marker": F.when(k == 1, "<h1>").when(k == 2, "<none>").when(k == 3, "<h1>"),
            "end_marker": F.when(k == 1, "</h1>").when(k == 2, "</none>"),
            "html": F.when(k == 4, F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>"))).when(k == 5, F.lit(None).cast("string")).otherwise(F.col("html")),
        }
    )


@query
def extract_precedence(spark, sf_dir):
    found = extract.extract_pages(_mixed(spark, sf_dir))
    return found.select("page_id", "extraction_method", "extraction_confident", "error", "sha256", F.col("block_count").cast("bigint").alias("block_count"))


@query
def extract_css_select(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", extract.css_text(F.col("html"), F.lit("head > title")).alias("title"), extract.css_text(F.col("html"), F.lit("div.ad")).alias("ad"))


@query
def page_fingerprints(spark, sf_dir):
    return extracted(spark, sf_dir).select("page_id", "extraction_method", "sha256", *(F.col(c).cast("bigint").alias(c) for c in ("main_content_length", "block_count", "word_count")), "has_cjk")


@query
def page_blocks(spark, sf_dir):
    return extracted(spark, sf_dir).select("page_id", F.posexplode("blocks").alias("pos", "block")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "block")


@query
def block_document_frequency(spark, sf_dir):
    return template.block_frequencies(extracted(spark, sf_dir))


@query
def common_blocks(spark, sf_dir):
    return template.common_blocks(extracted(spark, sf_dir), percent=CLEAN_PERCENT)


@query
def clean_blocks(spark, sf_dir):
    own, _ = cleaned(spark, sf_dir, CLEAN_PERCENT)
    return own.select("page_id", F.size("clean_blocks").cast("bigint").alias("n"), F.sha2(F.array_join("clean_blocks", " "), 256).alias("clean_sha256"))


@query
def exact_duplicate_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.sha256(X.collapse(F.col("text"))).alias("h"))
    groups = docs.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return docs.join(groups, "h").select("doc_id", "class_id", "copies")


@query
def trigram_counts(spark, sf_dir):
    return extracted(spark, sf_dir).select("page_id", F.size(X.trigram_codes(F.col("main_content"))).cast("bigint").alias("trigrams"))


@query
def document_trigrams(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(X.trigram_codes(F.col("text"))).cast("bigint").alias("trigrams"))


@query
def term_frequency(spark, sf_dir):
    own = extracted(spark, sf_dir).select("page_id", F.explode(X.tokens(F.col("main_content"))).alias("term"))
    return own.groupBy("page_id", "term").agg(F.count("*").alias("tf"))


def _overlaps(spark, sf_dir, of):
    return pairs.overlaps(pairs.features(extracted(spark, sf_dir)), of=of)


@query
def trigram_jaccard_pairs(spark, sf_dir):
    return _overlaps(spark, sf_dir, "g").select("k1", "k2", F.col("g").alias("shared"), pairs.jaccard().alias("jaccard_3gram"))


@query
def jaccard_prefix_pairs(spark, sf_dir):
    found = pairs.jaccard_above(pairs.features(extracted(spark, sf_dir)), 70)
    return found.select("k1", "k2", pairs.jaccard().alias("jaccard_3gram"))


@query
def tfidf_cosine_pairs(spark, sf_dir):
    return _overlaps(spark, sf_dir, "t").select("k1", "k2", pairs.cosine().alias("tfidf_cosine"))


@query
def block_overlap_pairs(spark, sf_dir):
    return _overlaps(spark, sf_dir, "b").select("k1", "k2", F.col("b").alias("shared"), pairs.block_overlap().alias("block_overlap"))


@query
def clean_view_pairs(spark, sf_dir):
    own, common = cleaned(spark, sf_dir, CLEAN_PERCENT)
    return pairs.score_pairs(own, common, urls=False, raw=False).select("k1", "k2", "jaccard_3gram_clean", "tfidf_cosine_clean", "block_overlap_clean")


@query
def pairs_scored(spark, sf_dir):
    return scored(spark, sf_dir).select("k1", "k2", "url1", "url2", "sha256_match", "jaccard_3gram", "tfidf_cosine", "block_overlap")


@query
def pairs_classified(spark, sf_dir):
    own = classify.classified(scored(spark, sf_dir), texts=False)
    return own.select("k1", "k2", "url1", "url2", "sha256_match", "jaccard_3gram", "tfidf_cosine", "block_overlap", "priority")


@query
def trigger_flags(spark, sf_dir):
    own = classify.classified(scored(spark, sf_dir, urls=False), texts=False).where("priority is not null")
    return own.select("k1", "k2", "priority", "hit_sha256", "hit_tfidf_cosine", "hit_jaccard_3gram", "hit_block_overlap")


@query
def trigger_reasons(spark, sf_dir):
    own = classify.classified(scored(spark, sf_dir, urls=False)).where("priority is not null")
    return own.select("k1", "k2", "priority", F.array_join("trigger_reasons", "; ").alias("reasons"))


def _classified(spark, sf_dir, urls=False):
    return classify.classified(scored(spark, sf_dir, urls), texts=False)


@query
def priority_counts(spark, sf_dir):
    return report.priority_counts(_classified(spark, sf_dir))


@query
def ci_gate(spark, sf_dir):
    return report.ci_gate(_classified(spark, sf_dir))


@query
def p1_top20(spark, sf_dir):
    return report.first_p1(_classified(spark, sf_dir, urls=True)).select("k1", "k2", "url1", "url2")


@query
def most_duplicated_top5(spark, sf_dir):
    return report.most_duplicated(_classified(spark, sf_dir, urls=True))


@query
def duplicate_statistics(spark, sf_dir):
    return report.duplicate_statistics(extracted(spark, sf_dir), _classified(spark, sf_dir))


@query
def audit_summary(spark, sf_dir):
    return report.page_summary(extract.with_raw_text(_mixed(spark, sf_dir)))


@query
def failure_gates(spark, sf_dir):
    return report.failure_gates(fixtures.table(spark, "status_pages")).withColumn("exit_code", F.col("exit_code").cast("bigint"))


@query
def robots_parse(spark, sf_dir):
    own = robots.parse_robots(fixtures.table(spark, "robots_files"))
    return own.select("host", "agent", F.col("rule_seq").cast("bigint").alias("rule_seq"), "allow", "pattern", F.col("length").cast("bigint").alias("length"))


@query
def robots_verdict(spark, sf_dir):
    rules = robots.parse_robots(fixtures.table(spark, "robots_files"))
    return robots.robots_verdict(fixtures.table(spark, "robots_urls"), rules, AGENT)


@query
def robots_crawl_delay(spark, sf_dir):
    return robots.delay_policy(robots.crawl_delays(fixtures.table(spark, "robots_files")))


@query
def robots_sitemaps(spark, sf_dir):
    return robots.sitemaps(fixtures.table(spark, "robots_files")).select("host", "sitemap")


@query
def robots_nothing_disallowed(spark, sf_dir):
    return robots.nothing_disallowed(robots.parse_robots(fixtures.table(spark, "robots_files")), AGENT)


@query
def robots_availability(spark, sf_dir):
    return robots.availability(fixtures.table(spark, "robots_status"))


@query
def ip_policy(spark, sf_dir):
    return policy.public_ipv4(fixtures.table(spark, "addresses"))


@query
def ip_policy_any(spark, sf_dir):
    own = fixtures.table(spark, "addresses").union(spark.createDataFrame([(x,) for x in ("::1", "2606:4700::1111", "::ffff:10.0.0.1", "64:ff9b::808:808", "fe80::1")], "ip string"))
    return own.select("ip", policy.public_ip(F.col("ip")).alias("is_public"))


@query
def media_type_filter(spark, sf_dir):
    return fixtures.table(spark, "responses").select("url", policy.media_type_problem(F.col("content_type")).alias("type_problem"), policy.encoding_problem(F.col("content_encoding")).alias("encoding_problem"))


@query
def response_size_filter(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", policy.size_problem(F.col("html"), 8000).alias("problem"))


@query
def resume_remaining(spark, sf_dir):
    return checkpoint.remaining(fixtures.table(spark, "planned"), fixtures.table(spark, "fetched")).select("input_idx", "url")


@query
def resume_inputs(spark, sf_dir):
    urls = fixtures.table(spark, "planned").select("url").union(fixtures.table(spark, "csv_rows").select("url"))
    return checkpoint.with_inputs(urls, inputs.with_nulls(fixtures.table(spark, "csv_rows")))


@query
def plan_union_distinct(spark, sf_dir):
    return checkpoint.plan_union(fixtures.table(spark, "fetched"), fixtures.table(spark, "planned"))


@query
def config_diff(spark, sf_dir):
    return checkpoint.config_differences(fixtures.table(spark, "saved_config"), fixtures.table(spark, "current_config"))


@query
def markdown_escape(spark, sf_dir):
    return fixtures.table(spark, "markdown").select("text", X.markdown_escape(F.col("text")).alias("escaped"))
