"""Training-data operators: deduplication, mixing, scoring, search, packing, extraction.

Nothing outside this folder (and ``corpus_pipeline.py``, which counts as part of it)
imports it. Each module holds one operator, the thin query that applies it to its
whole table and, where SQL can state the result, the SQL.
"""
