"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` of
``textfold.llm.queries`` are what the entry module registers.
"""
