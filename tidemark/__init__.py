"""Spark-native marketing attribution analytics, and operators for text corpora in ``tidemark.llm``."""
