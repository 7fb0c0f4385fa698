"""Corpus preparation: the ten numbered operators (see the README)."""
