"""Operators for corpora of training data; nothing else in the library imports this subpackage."""
