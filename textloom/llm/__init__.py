"""Operators for preparing language-model training data. Nothing else in the library imports this subpackage."""
