"""Operators for preparing language-model training data, their registered queries and SQL twins."""
