"""Column builders: loose values, predicates, aggregates, scalar functions, parameters."""
