"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it, apart from the guarded import in ``__spark_entry__``.
"""
