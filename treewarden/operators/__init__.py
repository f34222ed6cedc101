"""Relational operators: the node table, the analyzers, findings and their comparison."""
