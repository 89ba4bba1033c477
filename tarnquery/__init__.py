"""Spark-native analytics over a knowledge base of posts, pages and texts."""
