"""Lumenfold: full-text search, term statistics and corpus preparation on PySpark."""
