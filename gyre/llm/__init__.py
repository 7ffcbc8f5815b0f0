"""Operators of a pipeline for training data. Nothing outside this subpackage imports it."""
