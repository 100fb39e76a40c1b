"""Column expressions: text, predicates, scoring."""
