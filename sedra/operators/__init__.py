"""Operators: splitting, sentence similarity, embedding, vector search, ranking, collections."""
