"""Training-data operators: extraction, tokenising, deduplication, packing,
quality, language, token counts and license scans.

Nothing outside this folder imports it.  ``queries.py`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
