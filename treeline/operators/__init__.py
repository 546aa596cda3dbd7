"""Relational operators over files, facts, indexes, histories and evaluation runs."""
