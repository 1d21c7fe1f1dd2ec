"""gleaner: crawl-corpus analytics on Spark DataFrames."""
