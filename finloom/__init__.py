"""Spark-native analysis of company filings, statements, prices and relations."""
