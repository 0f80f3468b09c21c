"""Operators for preparing language-model training data, each a Spark job.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports
it.  ``queries.QUERIES`` lists what is registered.
"""
