"""Streams: our addition; a log that is continued by micro-batches."""
