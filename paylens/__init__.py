"""Spark-native analytics over pay, prices and job postings."""
