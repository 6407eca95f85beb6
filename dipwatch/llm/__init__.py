"""Operators for preparing training text, each a Spark job over whole tables.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
