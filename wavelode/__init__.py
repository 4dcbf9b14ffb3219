"""Time-series features, symbolic words and interpretable classification as Spark jobs."""
