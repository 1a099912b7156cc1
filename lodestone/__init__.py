"""Lodestone: retrieval-corpus analytics expressed as Spark DataFrame plans."""
