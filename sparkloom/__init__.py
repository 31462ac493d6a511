"""Hybrid retrieval and document analytics expressed as Spark DataFrame plans."""
