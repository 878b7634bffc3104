"""Characters of selected text are decoded as in the SQL."""

import duckdb
import pytest

from pagesim import oracle, queries
from pagesim.operators import css


@pytest.mark.parametrize(
    "inside, want",
    [("a &amp; b", "a & b"), ("a &amp", "a &amp"), ("a &am", "a &am"), ("&amp;lt;", "&lt;"), ("a&lt b &copy", "a&lt b &copy"), ("&quot;x&#39;&apos;&nbsp;&middot;", "\"x''\xa0·"), ("x && y &", "x && y &"), ("&lt;", "<"), ("&eacute;&#233;&#xE9;&nosuch;", "ééé&nosuch;")],
)
def test_only_references_that_end_are_decoded(inside, want):
    assert css.select_text(f"<head><title>{inside}</title></head>", "title") == want
    assert css.select_text(f"<p title='{'a&amp;b'}'>{inside}</p>", "[title='a&b']") == want


def test_scripts_keep_their_text():
    assert css.select_text("<script>a &amp;&amp; b &lt c</script>", "script") == "a &amp;&amp; b &lt c"


def test_cut_references_equal_sql(spark, tmp_path):
    titles = ["cut &amp", "cut &am", "all &amp; of it", "&quot", "&amp;amp;", "&amp;quot"]
    pages = [(k, f"http://h/{k}", f"<html><head><title>{t}</title></head><body><div class=\"ad\">{t}</div></body></html>") for k, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.QUERIES["extract_css_select"](spark, str(tmp_path)).select("page_id", "title", "ad").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(oracle.SQL["extract_css_select"]).project("page_id, title, ad").fetchall())
