"""Ownership-network functions."""
