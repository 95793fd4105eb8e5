"""Evaluation analytics as Spark DataFrame operators."""
