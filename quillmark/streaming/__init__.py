"""Streams: nothing here yet, as no operator keeps state between batches."""
