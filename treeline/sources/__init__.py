"""Readers: tables, repositories of files, JSON lines."""
