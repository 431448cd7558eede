"""Lookup tables of the ownership operators."""
