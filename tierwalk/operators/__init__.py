"""Ownership-network operators."""
