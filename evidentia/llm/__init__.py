"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries``
registers one query per operator over the shared tables. Nothing outside this
subpackage imports it.
"""
