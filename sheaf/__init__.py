"""Corpus-scale document, web-page and conversation operators on PySpark."""
