"""Ownership-network sources."""
