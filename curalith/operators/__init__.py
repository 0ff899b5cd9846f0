"""Operators on tables of transcripts, takes, metrics and logs."""
