"""Registered queries over the driver tables and their DuckDB SQL.

The reference's objects are stood in for by the driver's tables: documents for transcripts, benchmark
for the evaluation set, labels for what is known of some of them, embeddings for samples (64 of
them at 400 a second, frames of 8), events for pitch tracks, takes and logs.
"""

from curalith.plans import records, runs, signals, texts

_MODULES = (texts, records, signals, runs)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
