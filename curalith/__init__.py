"""A PySpark engine for preparing and auditing text and speech corpora."""
