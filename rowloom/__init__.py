"""Declarative record pipelines compiled to Spark DataFrame plans."""
