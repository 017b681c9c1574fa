"""Spark-first signature retrieval: ingestion, ranking, evaluation and diagnostics as DataFrame plans."""
