"""bourse: Spark-native market data, news and model-evaluation jobs."""
