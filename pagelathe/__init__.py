"""Reproducible document-text analytics, declared as Spark DataFrame plans."""
