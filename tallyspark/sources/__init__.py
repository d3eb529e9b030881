"""Readers and writers of statement files and test tables."""
