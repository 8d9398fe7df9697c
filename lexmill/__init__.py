"""Contract analytics over whole corpora, written as Spark DataFrame jobs."""
