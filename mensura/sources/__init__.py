"""Readers and writers: extracted records, catalog files, rules."""
