"""Column expressions: predicates, classifiers and scalar functions."""
