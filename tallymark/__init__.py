"""Spark-native analytics over labelled tables, recorded model responses, latency
reports, metric samples and artifact catalogs."""
