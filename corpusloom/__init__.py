"""Analytics over corpora of source files and texts, as Spark jobs."""
