"""Training-data operators: extraction, search, packing, filters, deduplication.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it.
"""
