"""Relational operators: joins, aggregates and windows over the snapshot tables."""
