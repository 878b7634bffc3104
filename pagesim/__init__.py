"""pagesim: page-similarity analytics on Spark DataFrames."""
