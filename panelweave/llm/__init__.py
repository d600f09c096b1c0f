"""Operators on text corpora for building training data, and their registered queries."""
