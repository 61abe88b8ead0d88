"""Readers and writers of text catalogues, Lua tables, tabular JSON, archives and pages."""
