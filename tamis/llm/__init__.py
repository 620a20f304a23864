"""Training-data operators.

Each module holds one operator with a general interface; ``queries`` holds the
thin contract queries and their SQL.  Nothing outside this subpackage imports
it, except ``__spark_entry__.py`` (guarded) and ``corpus_pipeline.py``.
"""
