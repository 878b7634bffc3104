"""Headline queries, timed. Prints one JSON line.

The page audit is timed over BENCH_PAGES pages (1,000: the largest crawl that one audit takes), all pairs, all signals.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
PAGES = int(os.environ.get("BENCH_PAGES", "1000"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from pagesim import queries
    from pagesim.operators import classify, extract, pairs

    pages = queries.pages(spark, SF_DIR).where(F.col("page_id") < PAGES)

    def audit():
        own = extract.extract_pages(pages).drop("html", "raw_text")
        return classify.classified(pairs.score_pairs(own), texts=False)

    timed = {"pairs_classified": audit}
    for name in ("page_fingerprints", "link_extract", "term_frequency", "exact_duplicate_groups", "document_trigrams", "block_document_frequency"):
        timed[name] = lambda f=queries.QUERIES[name]: f(spark, SF_DIR)
    pages.limit(5).write.format("noop").mode("overwrite").save()
    took = {}
    for name, f in timed.items():
        begin = time.time()
        f().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begin, 3)
    n = pages.count()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "pairs": n * (n - 1) // 2, "pairs_per_sec": round(n * (n - 1) / 2 / took["pairs_classified"])}))


if __name__ == "__main__":
    main()
