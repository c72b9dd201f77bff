"""Training-data pipeline operators: mixing, quality, dedup, decontamination, HTML, WARC, LM, language id.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports
it.  ``queries`` holds the registered ``opN_*`` queries and their SQL.
"""
