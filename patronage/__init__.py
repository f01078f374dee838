"""Retail loyalty analytics as Spark DataFrame operators."""
