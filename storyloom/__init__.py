"""A Spark-native engine for news streams: articles, stories, feeds and their metrics."""
