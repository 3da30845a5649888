"""Lexical matching of question batches against knowledge bases, as Spark jobs."""
