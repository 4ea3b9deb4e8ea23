"""Quire: document-corpus analytics as DataFrame-in, DataFrame-out functions on PySpark."""
