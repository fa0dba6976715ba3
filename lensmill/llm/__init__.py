"""Operators that prepare text corpora for language-model training. Nothing else in lensmill imports this."""
