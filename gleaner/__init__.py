"""Corpus curation and layout analytics as DataFrame operators."""
