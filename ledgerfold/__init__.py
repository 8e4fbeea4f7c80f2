"""Weighted-return and feature analytics as plain Spark DataFrame operators."""
