"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it, except the registration in
``__spark_entry__.py``.
"""
