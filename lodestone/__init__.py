"""Hybrid document search and corpus analytics as Spark DataFrame plans."""
