"""Lexarium: quantitative text analysis and authorship attribution as Spark DataFrame operations."""
