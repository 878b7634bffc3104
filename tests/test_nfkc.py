"""NFKC without Python workers, whose memory grew with the batches of texts."""

import unicodedata

from pyspark.sql import functions as F

from pagesim import queries
from pagesim.functions import text as X


def test_no_text_leaves_the_jvm(spark):
    for name in ("common_blocks", "page_fingerprints"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "InArrow" not in plan


def test_nfkc_of_every_assigned_character(spark):
    points = [c for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    rows = [(f"a{chr(c)}̣́{chr(c)}",) for c in points] + [("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select("t", X.nfkc(F.col("t")).alias("n")).collect()
    assert len(got) == len(rows)
    assert all(r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t)) for r in got)
