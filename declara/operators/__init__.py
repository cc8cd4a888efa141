"""Relational operators: extraction, lineage, graphs, checks, state."""
