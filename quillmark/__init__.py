"""Quillmark: extract, reconcile and publish structured reference tables with Spark."""
