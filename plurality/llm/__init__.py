"""Operators for training-data pipelines; nothing else in the library imports this subpackage.

``queries()`` and ``oracle_sql()`` list what ``__spark_entry__.py`` registers.
"""

from plurality.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
