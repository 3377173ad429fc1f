"""Retail price analytics on Spark."""
