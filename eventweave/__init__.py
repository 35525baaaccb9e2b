"""Spark-native analytics for syndicated news: feeds to articles, articles to
event stories, stories to feeds, and reader telemetry. DataFrame in, DataFrame out."""
