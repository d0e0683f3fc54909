"""Corpus-trained autocomplete and text analytics on Spark."""
