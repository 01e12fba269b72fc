"""Operators of a large-scale training-data pipeline.

Operators, each in a module of its own, on the tables ``documents``, ``pages``,
``benchmark``, ``labels``, ``embeddings`` and ``conversations``.  :mod:`.queries` registers
them; nothing else in the library imports this subpackage.
"""
