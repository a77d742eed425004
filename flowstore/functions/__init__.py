"""Column expressions: predicates, expressions, scalar helpers and identifiers."""
