"""Training-data operators for document, page and embedding tables.

Nothing else in the library imports this subpackage; it may be removed
together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
