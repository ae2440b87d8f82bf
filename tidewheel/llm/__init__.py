"""Operators for building training corpora, each usable on any DataFrame."""
