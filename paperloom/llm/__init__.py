"""Training-data operators: tokenising, packing, deduplication, scoring, vector search and archives.

Nothing outside this folder imports it, save the guarded hook in ``__spark_entry__`` and
``corpus_pipeline``.
"""
