"""Training-data operators: extraction, formatting, tokens, language, quality, copies, archives and search.

Each operator module keeps a general interface; ``queries`` binds them to the
synthetic tables. Nothing outside this folder and ``corpus_pipeline`` imports it.
"""
