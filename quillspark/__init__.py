"""Corpus-trained autocomplete as Spark plans, with operators for preparing training corpora in ``llm``."""
