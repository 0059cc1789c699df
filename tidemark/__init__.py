"""Tidemark: market-data, trade-record and corpus analytics expressed as Spark DataFrame jobs."""
