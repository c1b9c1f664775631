"""Analytics over repositories and other line- and event-structured corpora, on Spark DataFrames."""
