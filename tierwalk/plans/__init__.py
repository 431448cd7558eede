"""Ownership-network plans."""
