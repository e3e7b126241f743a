"""Operators over the corpus: chunking, retrieval, analysis, evaluation, expansion, merging."""
