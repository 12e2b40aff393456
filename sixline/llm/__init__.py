"""Operators on text and records for training corpora. Nothing outside this subpackage imports it."""
