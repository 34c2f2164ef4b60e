"""Corpus analytics as PySpark DataFrame functions."""
