"""Relational operators: select, rewrite of rows, constraint checks, referential actions."""
