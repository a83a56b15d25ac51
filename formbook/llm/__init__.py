"""Operators for building training corpora: filters, duplicates, leaks, secrets, search and mixing.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries where it is present.
"""
