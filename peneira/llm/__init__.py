"""Operators for training data: the problems tagged llm. Nothing else in the library imports this subpackage."""
