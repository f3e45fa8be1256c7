"""Retail and supply-chain analytics as plain Spark DataFrame functions."""
