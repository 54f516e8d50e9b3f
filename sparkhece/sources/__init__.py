"""Readers and writers of lexicons, corpora, models and results."""
