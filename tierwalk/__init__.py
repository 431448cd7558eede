"""Ownership-network analytics on Spark."""
