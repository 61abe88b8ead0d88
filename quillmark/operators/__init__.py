"""Mapping, merging, comparing and looking up tables."""
