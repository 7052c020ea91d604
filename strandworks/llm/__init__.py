"""Operators for training-data pipelines at corpus scale.

Nothing else in the library imports this subpackage.  ``queries`` and
``oracle_sql`` in :mod:`strandworks.llm.queries` list what the entry file adds.
"""
