"""Spark-native collection, cleaning and analytics of web content."""
