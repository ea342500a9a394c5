"""Operators on dependency graphs: ``nodes(id)`` and ``edges(source_id, target_id)``.

A source feeds its target. Ids may be of any type that can be compared.
"""
