"""Analytics over agent transcripts on Spark: ingestion, roll-ups, search and usage reports as DataFrame plans."""
