"""Spark-native analytics for open-source and social-media research data."""
