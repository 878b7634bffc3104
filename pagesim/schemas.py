"""Row types of the tables that operators hand to one another."""

from pyspark.sql import types as T

PAGE_INPUT = T.StructType(
    [
        T.StructField("input_idx", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("selector", T.StringType()),
        T.StructField("start_marker", T.StringType()),
        T.StructField("end_marker", T.StringType()),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("input_idx", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("extraction_confident", T.BooleanType()),
        T.StructField("main_content", T.StringType()),
        T.StructField("main_content_length", T.IntegerType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("block_count", T.IntegerType()),
        T.StructField("blocks", T.ArrayType(T.StringType())),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("has_cjk", T.BooleanType()),
    ]
)
#: What reports show of a page, and the columns of the pair report in order.
PUBLIC_PAGE = ["url", "status_code", "error", "extraction_method", "extraction_confident", "main_content_length", "sha256", "block_count", "word_count", "has_cjk"]
PAIR_REPORT = ["url1", "url2", "priority", "sha256_match", "jaccard_3gram", "tfidf_cosine", "block_overlap", "jaccard_3gram_clean", "tfidf_cosine_clean", "block_overlap_clean", "trigger_reasons"]
EDGE = T.StructType([T.StructField("src_url", T.StringType()), T.StructField("dst_url", T.StringType())])
