"""Training-data operators: text, web-page and corpus-mixing jobs.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports
it.  ``registry.py`` holds the queries and their DuckDB oracles.
"""
