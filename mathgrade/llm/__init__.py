"""Training-data operators over documents, pages, embeddings and conversations.

One module per operator; ``queries.py`` holds the registered queries and their
oracle SQL. Nothing outside this subpackage (and ``corpus_pipeline.py``)
imports it.
"""
